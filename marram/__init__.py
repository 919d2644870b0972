"""Spark-native engine for deterministic evidence retrieval."""
