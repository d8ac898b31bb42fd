"""Spark-native engine for building, linking and evaluating knowledge graphs from text."""
