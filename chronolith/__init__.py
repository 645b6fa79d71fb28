"""Spark-native analytics over time intervals, events and sampled signals."""
