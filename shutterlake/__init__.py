"""Spark-native analytics over the catalogue of a large media library."""
