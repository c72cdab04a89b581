"""Lodestone: a PySpark-native engine for text corpora and vector statistics."""

__version__ = "0.1.0"
