"""Spark-native engine for correlating ordered depth series."""
