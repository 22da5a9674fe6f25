"""Spark-native analytics over collections of text notes, their embeddings and their graph."""
