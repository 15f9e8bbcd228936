"""Notegrove: a PySpark-native engine for document corpora and the note graphs built from them."""

__version__ = "0.1.0"
