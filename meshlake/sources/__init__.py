"""Sources of the mesh analytics engine."""
