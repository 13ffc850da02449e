"""Spark-native embedding retrieval, sequence search and evaluation engine."""
