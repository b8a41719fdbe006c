"""Sources of Palaver."""
