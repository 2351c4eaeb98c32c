"""Spark-native engine for firm panels, filings text and training-corpus preparation."""

__version__ = "0.1.0"
