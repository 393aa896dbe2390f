"""Spark-native sources."""
