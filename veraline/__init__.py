"""Spark-native data-trust, evaluation and corpus analytics."""
