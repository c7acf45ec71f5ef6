"""Stylometry and text analytics as PySpark DataFrame transforms."""
