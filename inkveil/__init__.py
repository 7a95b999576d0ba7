"""Spark-native detection, location, masking and auditing of sensitive text."""
