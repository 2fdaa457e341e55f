"""Spatial boundary analytics on PySpark, with scenarios as the unit of scale-out."""
