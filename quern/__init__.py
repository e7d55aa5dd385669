"""Spark-native analytics over multilingual text corpora."""
