"""Spark-native analytics for multilingual dialogue corpora."""

__version__ = "0.1.0"
