"""Spark-native engine for evidence-backed knowledge graphs."""
