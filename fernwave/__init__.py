"""Spark-native analytics over 3-D point structures and their contact graphs."""
