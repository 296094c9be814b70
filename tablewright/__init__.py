"""Spark-native operators for judging and producing private tabular data."""

__version__ = "0.1.0"
