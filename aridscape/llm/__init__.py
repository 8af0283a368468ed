"""Operators for training-data pipelines over documents, vectors, pages and conversations."""
