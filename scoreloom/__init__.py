"""Spark-native analytics over match logs, belief tables and experiment evidence."""

__version__ = "0.1.0"
