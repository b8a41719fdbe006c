"""Streaming of Palaver."""
