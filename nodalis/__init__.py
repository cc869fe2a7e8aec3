"""Spark-native analytics for time-evolving graphs."""

__version__ = "0.1.0"
