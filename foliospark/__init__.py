"""Spark-native analytics over chunked scanned-document containers."""
