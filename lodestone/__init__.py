"""Spark jobs for retrieval-augmented question answering over large corpora."""
