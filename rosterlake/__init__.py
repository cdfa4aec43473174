"""Spark-native engine for published party lists: ingest, clean, merge, index and screen."""
