"""Spark-native multi-criteria risk mapping and drought analytics."""

__version__ = "0.1.0"
