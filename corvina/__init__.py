"""Spark-native document, retrieval and data-quality analytics."""

__version__ = "0.1.0"
