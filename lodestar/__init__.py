"""Lodestar: Spark-native analytics over linked text collections."""
