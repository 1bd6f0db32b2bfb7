"""Spark-native engine for cleaning, structuring and auditing long-form documents."""

__version__ = "0.1.0"
