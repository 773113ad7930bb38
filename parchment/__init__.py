"""Spark-native corpus review engine."""
