"""Spark-native analytics over financial tables, text and programs."""

__version__ = "0.1.0"
