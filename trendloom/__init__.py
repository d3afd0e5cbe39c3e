"""Spark-native topic discovery and hot-topic analytics."""
