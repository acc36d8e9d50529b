"""Incremental document-corpus processing on stock Spark."""
