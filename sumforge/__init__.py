"""Sumforge: Spark-native processing of mathematical-expression corpora."""
