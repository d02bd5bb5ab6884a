"""Spark-native engine for building and analysing model-evaluation benchmarks."""
