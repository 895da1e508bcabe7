"""Relational, graph, vector and merge operators."""
