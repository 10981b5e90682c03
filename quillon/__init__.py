"""Quillon: Spark-native data processing and analytics for language-model data."""
