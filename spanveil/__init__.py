"""Spark-native document de-identification."""
