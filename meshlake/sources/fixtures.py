"""Meshes and points derived from the driver's tables, in long form.

``box`` and ``lprism``: one closed mesh per part, scaled from a template; ``beam``: an L-prism, long and slim, per supplier.
``soup``: triangles of consecutive line items of an order. ``cloud``: points of embeddings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meshlake.operators.aggregates import MESH, dealt

BOX_POINTS = [(x, y, z) for z in (0.0, 1.0) for x, y in ((0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0))]
BOX_FACES = [
    (0, 2, 1), (0, 3, 2), (4, 5, 6), (4, 6, 7), (0, 1, 5), (0, 5, 4),
    (1, 2, 6), (1, 6, 5), (2, 3, 7), (2, 7, 6), (3, 0, 4), (3, 4, 7),
]
_L = [(0.0, 0.0), (2.0, 0.0), (2.0, 1.0), (1.0, 1.0), (1.0, 2.0), (0.0, 2.0)]
LPRISM_POINTS = [(x, y, z) for z in (0.0, 1.0) for x, y in _L]
LPRISM_FACES = [(0, k + 1, k) for k in range(1, 5)] + [(6, 6 + k, 7 + k) for k in range(1, 5)] + [
    f for i in range(6) for f in ((i, (i + 1) % 6, (i + 1) % 6 + 6), (i, (i + 1) % 6 + 6, i + 6))
]
_E = 0.05
_CAGE = [(-_E, -_E), (2 + _E, -_E), (2 + _E, 1 + _E), (1 + _E, 1 + _E), (1 + _E, 2 + _E), (-_E, 2 + _E)]
CAGE_POINTS = [(x, y, z) for z in (-_E, 1 + _E) for x, y in _CAGE]
TEMPLATES = {
    "box": (BOX_POINTS, BOX_FACES), "lprism": (LPRISM_POINTS, LPRISM_FACES), "cage": (CAGE_POINTS, LPRISM_FACES), "beam": (LPRISM_POINTS, LPRISM_FACES),
}


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``mesh_id, p_size`` of ``part``, dealt by mesh: the file is small, often one task's, and each row becomes many."""
    return dealt(spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("mesh_id"), "p_size"), MESH)


def _parts(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    if kind == "beam":
        key = F.col("s_suppkey")
        sizes = [(40 + key % 11).alias("sx"), (2 + key % 2).alias("sy"), (2 + key % 3).alias("sz")]
        rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(key.alias("mesh_id"), *sizes)
        return dealt(rows.select("mesh_id", *[F.col(c).cast("double").alias(c) for c in ("sx", "sy", "sz")]), MESH)
    part = parts(spark, sf_dir)
    return part.select(
        "mesh_id",
        F.col("p_size").cast("double").alias("sx"),
        (1 + F.col("mesh_id") % 7).cast("double").alias("sy"),
        (1 + F.col("mesh_id") % 5).cast("double").alias("sz"),
    )


def vertices(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """``mesh_id, part_id, vertex_id, x, y, z``."""
    points = F.array(*[F.struct(*map(F.lit, p)) for p in TEMPLATES[kind][0]])
    points = points.cast("array<struct<x:double,y:double,z:double>>")
    rows = _parts(spark, sf_dir, kind).select("*", F.posexplode(points).alias("vertex_id", "p"))
    return rows.select(
        "mesh_id", F.lit(0).alias("part_id"), "vertex_id",
        (F.col("p.x") * F.col("sx")).alias("x"), (F.col("p.y") * F.col("sy")).alias("y"), (F.col("p.z") * F.col("sz")).alias("z"),
    )


def triangles(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """``mesh_id, part_id, triangle_id, v0, v1, v2``."""
    faces = F.array(*[F.struct(*map(F.lit, f)) for f in TEMPLATES[kind][1]]).cast("array<struct<v0:int,v1:int,v2:int>>")
    rows = _parts(spark, sf_dir, kind).select("mesh_id", F.posexplode(faces).alias("triangle_id", "f"))
    return rows.select("mesh_id", F.lit(0).alias("part_id"), "triangle_id", "f.v0", "f.v1", "f.v2")


def soup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``mesh_id, triangle_id, ax .. cz``: a line item and the next two of its order; (order, line) isn't unique, so it is made so first."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    points = items.groupBy(F.col("l_orderkey").alias("mesh_id"), F.col("l_linenumber").cast("int").alias("triangle_id")).agg(
        F.min("l_quantity").cast("double").alias("ax"),
        (F.min("l_discount").cast("double") * 100).alias("ay"),
        (F.min("l_tax").cast("double") * 100).alias("az"),
    )
    order = Window.partitionBy("mesh_id").orderBy("triangle_id")
    ahead = {f"{p}{axis}": F.lead(f"a{axis}", n).over(order) for p, n in (("b", 1), ("c", 2)) for axis in "xyz"}
    return points.withColumns(ahead).where("cx IS NOT NULL")


def cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``mesh_id, part_id, vertex_id (long), x, y, z``: the first three components of each embedding; parts are labels."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    xyz = [F.col("embedding")[k].cast("double").alias(axis) for k, axis in enumerate("xyz")]
    return rows.select(F.lit(0).cast("long").alias("mesh_id"), F.col("label").cast("int").alias("part_id"), F.col("vec_id").alias("vertex_id"), *xyz)
