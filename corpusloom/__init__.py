"""Spark-native curation and measurement of text corpora."""

__version__ = "0.1.0"
