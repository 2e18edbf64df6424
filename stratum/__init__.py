"""Spark-native columnar analytics engine."""
