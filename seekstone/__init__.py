"""Seekstone: structure-aware semantic search and corpus processing on PySpark."""

__version__ = "0.1.0"
