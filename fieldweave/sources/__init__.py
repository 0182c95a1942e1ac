"""Sources of the extraction engine."""
