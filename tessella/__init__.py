"""Spark-native analytics over ordered data, arrays, grids and corpora."""
