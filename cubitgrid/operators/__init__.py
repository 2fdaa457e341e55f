"""Set operations on buildings, cities and points."""
