"""Spark-native retrieval and graph analytics over code and document tables."""

__version__ = "0.1.0"
