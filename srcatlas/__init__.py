"""Batch analysis of source-repository corpora on Spark."""
