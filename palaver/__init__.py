"""Palaver: search and analytics over conversation archives, built on PySpark."""
