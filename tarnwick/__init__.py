"""Spark-native retrieval, question answering and evaluation over tables."""
