"""Spark-native forensic record analytics."""
