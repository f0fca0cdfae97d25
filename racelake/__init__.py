"""Spark-native operators and stages for lap-level and race-level tables."""
