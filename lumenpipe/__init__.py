"""Spark-native telemetry analytics: a pipe language over traces, logs, metrics and profiles."""
