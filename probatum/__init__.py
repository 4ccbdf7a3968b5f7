"""Corpus building, evidence retrieval and evidence checking as Spark DataFrame jobs."""

__version__ = "0.1.0"
