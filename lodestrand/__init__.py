"""Spark-native extraction of code blocks from documents, and preparation of text corpora."""
