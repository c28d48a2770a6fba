"""Spark-native analytics for threaded discussions: reply cascades, statistics, text, survival and data preparation."""
