"""Operators of Palaver."""
