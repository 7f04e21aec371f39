"""Spark-native storage, retrieval and preparation of conversational memory records."""
