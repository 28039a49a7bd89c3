"""Tidy verbs for Spark DataFrames."""
