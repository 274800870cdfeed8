"""Quillon: a Spark-native analytics engine for instrument-by-date panels."""

__version__ = "0.1.0"
