"""Spark-native checking of written claims against packs of source documents."""
