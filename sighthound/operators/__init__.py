"""Operators of the sighting engine."""
