"""Spark-native corpus and conversation analytics."""
