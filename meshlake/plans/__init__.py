"""Plans of the mesh analytics engine."""
