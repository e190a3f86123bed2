"""Relational operators: resolution, graph construction, traversal, analytics."""
