"""Spark-native analytics for security-incident text."""
