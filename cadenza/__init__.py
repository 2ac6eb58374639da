"""Spark-native analytics for ride telemetry and routes."""
