"""Spark-native synthetic tabular data: fit, generate, evaluate, read and write."""
