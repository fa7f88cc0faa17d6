"""Operators for training-data pipelines over text, URL and embedding tables."""
