"""Spark-native near-duplicate detection and similarity grouping."""
