"""Spark-native duplication and quality analytics."""
