"""Spark-native analytics for building, auditing and scoring text corpora."""
