"""Batch-first hybrid text retrieval on Spark DataFrames."""

__version__ = "0.1.0"
