"""Operators for large-scale training-data preparation.

Nothing outside this folder imports it; it imports nothing from the rest of the library.
"""
