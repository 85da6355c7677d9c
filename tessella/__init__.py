"""Tessella: document analytics, hybrid retrieval and corpus preparation on PySpark."""

__version__ = "0.1.0"
