"""Terrane: retrieval analytics over document collections as Spark plans."""

__version__ = "0.1.0"
