"""Spark-native text preparation for speech, at table scale."""

__version__ = "1.0.0"
