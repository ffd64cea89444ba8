"""Facet navigation and analytics on PySpark."""
