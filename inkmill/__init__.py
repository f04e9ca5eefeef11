"""Spark-native engine that turns raw prose into training and evaluation corpora."""

__version__ = "0.1.0"
