"""Corpus search, retrieval indexes and corpus preparation as Spark jobs."""
