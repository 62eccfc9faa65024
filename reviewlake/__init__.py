"""Retrieval-augmented review analytics expressed as Spark jobs."""
