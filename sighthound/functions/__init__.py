"""Functions of the sighting engine."""
