"""Curation of conversation and web text on Spark."""
