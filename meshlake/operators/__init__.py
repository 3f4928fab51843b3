"""Operators of the mesh analytics engine."""
