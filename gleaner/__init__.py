"""Spark-native retrieval, corpus preparation and answering engine."""
