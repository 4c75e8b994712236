"""Spark-native grounded retrieval and evaluation engine."""
