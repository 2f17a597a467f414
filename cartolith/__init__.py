"""Cartolith: source-code graph analytics on PySpark."""
