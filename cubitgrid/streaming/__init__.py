"""Scenarios that arrive as a stream."""
