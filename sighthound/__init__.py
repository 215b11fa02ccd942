"""Spark-native analytics over detections, tracks, identities and journeys."""
