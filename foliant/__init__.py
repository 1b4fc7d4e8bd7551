"""Spark-native document conversion and document-model engine."""
