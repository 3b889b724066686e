"""Spark-native analytics over streaming-media delivery data."""
