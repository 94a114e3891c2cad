"""Spark-native announcement intelligence engine."""
