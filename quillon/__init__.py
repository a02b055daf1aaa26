"""Spark-native curation, similarity, audit and training-data operators."""
