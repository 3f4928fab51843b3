"""meshlake: batch geometry analytics over triangle meshes, declared as Spark DataFrames."""

__version__ = "0.1.0"
