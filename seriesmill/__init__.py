"""Spark-native time-series analytics."""
