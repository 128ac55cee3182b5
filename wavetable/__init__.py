"""Spark-native time-frequency analytics over long trace tables."""
