"""Spark-native memory retrieval and text-data engine."""

__version__ = "0.1.0"
