"""Strandline: ordered-sequence and content-addressed analytics on PySpark."""

__version__ = "0.1.0"
