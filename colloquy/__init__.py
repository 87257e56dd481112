"""Spark-native operators for conversation data, retrieval and text corpora."""
