"""Spark-native engine for preparing, correcting and evaluating text corpora."""
