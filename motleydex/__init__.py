"""Spark-native hybrid retrieval and label analytics."""
