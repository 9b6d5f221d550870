"""Spark-native analytics for indoor spatial captures and their evaluation."""
