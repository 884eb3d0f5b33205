"""Corpus preparation and summary evaluation as Spark jobs."""
