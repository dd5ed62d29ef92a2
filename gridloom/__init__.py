"""Gridded and point time-series analytics as lazy PySpark DataFrame transformations."""
