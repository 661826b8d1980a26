"""Spark-native household-certification audit engine."""
