"""Relational retrieval analytics on Spark."""
