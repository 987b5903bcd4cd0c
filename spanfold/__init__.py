"""Spark-native metrics aggregation."""
