"""Functions of Palaver."""
