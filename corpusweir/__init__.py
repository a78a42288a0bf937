"""Spark-native retrieval and document analytics."""
