"""Spark-first document privacy analytics: detection, pseudonymisation and redaction planning."""
