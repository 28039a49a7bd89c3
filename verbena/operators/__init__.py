"""Verbs of tables."""
