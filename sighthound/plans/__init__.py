"""Plans of the sighting engine."""
