"""Operators on edge and adjacency frames."""
