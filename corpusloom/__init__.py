"""Spark-native auditing of captured web corpora."""
