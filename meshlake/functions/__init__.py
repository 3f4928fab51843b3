"""Functions of the mesh analytics engine."""
