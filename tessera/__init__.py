"""Tessera: retrieval and corpus analytics as Spark DataFrame operations."""

__version__ = "0.1.0"
