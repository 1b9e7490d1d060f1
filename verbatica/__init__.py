"""Spark-native analytics for keyed speech-transcript data."""
