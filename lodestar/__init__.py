"""Retrieval and document analytics on Spark."""
