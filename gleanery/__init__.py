"""Spark-first document analytics and evidence retrieval."""
