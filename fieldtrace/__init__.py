"""Spark-native analytics over timed positions, radio observations, point assets and text corpora."""
