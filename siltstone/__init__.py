"""Siltstone: retrieval-grounded text analytics as Spark DataFrame jobs."""

__version__ = "0.1.0"
