"""Spark-native analytics over business documents whose structure drifts."""
