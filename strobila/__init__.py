"""Spark-native analytics for the structure and timing of ISO base-media files."""
