"""Spark-native analytics over headline and article streams."""
