"""Operators over a graph; each returns a DataFrame."""
