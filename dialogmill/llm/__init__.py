"""Operators for large-scale training-data pipelines.

Self-contained: nothing outside this folder (and ``corpus_pipeline.py``) imports it.
"""
