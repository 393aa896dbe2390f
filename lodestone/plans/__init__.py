"""Spark-native plans."""
