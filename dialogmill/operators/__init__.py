"""Relational operators: they take and return DataFrames."""
