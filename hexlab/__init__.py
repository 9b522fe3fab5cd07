"""Spark-native analytics on hexagonal grids."""
