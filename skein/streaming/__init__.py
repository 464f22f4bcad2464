"""Triangles of a growing graph."""
