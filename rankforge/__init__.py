"""Spark-native analytics for ranked-profile data."""
