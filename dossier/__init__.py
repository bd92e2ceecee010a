"""Spark-native processing of personal-record documents."""
