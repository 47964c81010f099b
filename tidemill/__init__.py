"""Tidemill: corpus preparation, retrieval and evaluation as Spark DataFrame jobs."""
