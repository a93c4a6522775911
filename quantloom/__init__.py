"""Spark-native analytics for multi-asset portfolio research."""
