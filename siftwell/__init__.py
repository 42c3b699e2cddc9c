"""Retrieval-corpus analytics as Spark DataFrame jobs."""
