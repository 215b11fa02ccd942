"""Streaming of the sighting engine."""
