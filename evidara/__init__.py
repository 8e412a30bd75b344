"""Evidara: a Spark-native engine for candidate-set evidence."""
