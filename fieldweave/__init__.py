"""Spark-native adaptive extraction of fields from semi-structured documents."""
