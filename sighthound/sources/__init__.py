"""Sources of the sighting engine."""
