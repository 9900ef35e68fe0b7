"""Spark-native analytics over scholarly records and text corpora."""
