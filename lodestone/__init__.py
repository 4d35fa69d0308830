"""Lodestone: retrieval-style analytics over text and code, as PySpark DataFrame operators."""
