"""Spark-native document intelligence: classify, extract, correct, validate and store documents as tables."""
