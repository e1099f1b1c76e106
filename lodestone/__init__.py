"""Grounded-text analytics on Spark: retrieval, curation, tracing and training-data operators."""
