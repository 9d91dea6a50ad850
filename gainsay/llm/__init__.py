"""Operators for training-data pipelines over documents, pages, embeddings and benchmark items."""
