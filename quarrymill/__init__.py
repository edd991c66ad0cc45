"""Spark-native document analytics: text, keywords, entities, gazetteers, graphs."""

__version__ = "0.1.0"
