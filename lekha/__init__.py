"""Spark-native Bengali text processing: Column and DataFrame functions."""
