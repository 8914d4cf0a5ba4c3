"""Lectern: a Spark-native engine for research-library search, indexing and curation."""

__version__ = "0.1.0"
