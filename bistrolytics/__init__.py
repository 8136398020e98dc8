"""Spark-native analytics for order, catalog, feedback and chat tables."""
