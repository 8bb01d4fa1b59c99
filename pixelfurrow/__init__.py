"""Spark-native analytics over gridded imagery, field samples and text corpora."""
