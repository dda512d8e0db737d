"""Spark-native analytics over a corpus of civic documents and the conversations about it."""
