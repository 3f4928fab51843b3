"""Per-mesh aggregations, and the gather of triangle corners that they stand on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshlake.functions.geometry import distance, fields, radius_of_volume, signed_volume, triangle_area, vec

MESH, PART = ["mesh_id"], ["mesh_id", "part_id"]
#: Rows to a task of a table that is dealt by size.
ROWS = 1_000_000


def dealt(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` dealt by mesh to as many tasks as there are shuffle partitions, or twice the cores if those are more.

    The rows of a mesh are few bytes but much work: Spark must not join tasks by size.
    """
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    return df.repartition(n, *keys)


def tasks_for(df: DataFrame) -> int:
    """Tasks for the rows of ``df``, straight from files that may be large: as many as :func:`dealt` takes, or more, so that none has more than ``ROWS`` on average. Rows are counted from footers."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism, -(-df.count() // ROWS))


def dealt_by_work(df: DataFrame, sizes: DataFrame, n_tasks: int, size: str = "size", keys: list[str] = MESH) -> DataFrame:
    """``df`` dealt by mesh so that tasks have about equal work; ``sizes(keys, size)`` tells a mesh's.

    The longest first: meshes in order of size are dealt forth and back over the tasks, so that each gets one of every
    size. The order comes from ranks by range (:func:`meshlake.operators.relations.with_rank`): no task sees all meshes. One that
    is larger than a task's share still is one task's. Of equal sizes the smaller id comes first; meshes without a size go to task 0.
    """
    from meshlake.operators.relations import with_rank

    less = sizes.select(*keys, (-F.col(size)).alias("_less"))
    nth = (F.col("rank") - 1) % (2 * n_tasks)
    task = F.when(nth < n_tasks, nth).otherwise(2 * n_tasks - 1 - nth).cast("int")
    placed = with_rank(less, ["_less", *keys]).select(*keys, task.alias("_task"))
    rows = df.join(placed, keys, "left").withColumn("_task", F.coalesce("_task", F.lit(0)))
    return rows.repartitionById(n_tasks, "_task").drop("_task")


def corners(triangles: DataFrame, vertices: DataFrame, keys: list[str] = PART) -> DataFrame:
    """``keys, triangle_id, ax .. cz``.

    Both sides are gathered per mesh, which is the unit that fits in a row, and joined on the
    mesh: one shuffle for each instead of one for each corner.
    """
    points = vertices.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("vertex_id", "x", "y", "z"))).alias("vs"))
    faces = triangles.groupBy(*keys).agg(F.collect_list(F.struct("triangle_id", "v0", "v1", "v2")).alias("ts"))
    both = faces.join(points, keys)

    def gathered(t: Column) -> Column:
        point = [F.element_at("vs", (t[f"v{k}"] + 1).cast("int")) for k in range(3)]
        return F.struct(
            t["triangle_id"].alias("triangle_id"), *[p[axis].alias(f"{c}{axis}") for c, p in zip("abc", point, strict=True) for axis in "xyz"]
        )

    return both.select(*keys, F.inline(F.transform("ts", gathered)))


def bounding_box(vertices: DataFrame, keys: list[str] = PART) -> DataFrame:
    """``keys, min_x .. max_z``; a mesh without vertices has no row."""
    return vertices.groupBy(*keys).agg(*[f(axis).alias(f"{name}_{axis}") for name, f in (("min", F.min), ("max", F.max)) for axis in "xyz"])


def _scaled(rows: DataFrame, inverse: bool) -> DataFrame:
    side = F.greatest(*[F.col(f"max_{a}") - F.col(f"min_{a}") for a in "xyz"])
    out = {}
    for a in "xyz":
        middle = (F.col(f"max_{a}") + F.col(f"min_{a}")) / 2
        out[a] = F.col(a) * side / 2 + middle if inverse else F.try_divide(2 * (F.col(a) - middle), side)
    return rows.withColumns(out)


def normalize(points: DataFrame, box: DataFrame, keys: list[str] = MESH) -> DataFrame:
    """Points so that the longest side of their mesh's box spans -1 to 1; null if the box is a point. ``points`` may be others than the box was made of."""
    return _scaled(points.join(box, keys), False).select(*points.columns)


def unnormalize(points: DataFrame, box: DataFrame, keys: list[str] = MESH) -> DataFrame:
    return _scaled(points.join(box, keys), True).select(*points.columns)


def measures(corner_rows: DataFrame, keys: list[str] = PART) -> DataFrame:
    """``keys, volume, area, n_triangles``: signed volume and surface area."""
    a, b, c = vec("a"), vec("b"), vec("c")
    return corner_rows.groupBy(*keys).agg(
        F.sum(signed_volume(a, b, c)).alias("volume"), F.sum(triangle_area(a, b, c)).alias("area"), F.count("*").alias("n_triangles")
    )


def volume_radius(first: DataFrame, second: DataFrame, combined: DataFrame | None = None, keys: list[str] = MESH) -> DataFrame:
    """``keys, rv``: radius of the sphere as large as the volumes differ; with ``combined``, of first + second - combined."""
    rows = first.select(*keys, F.col("volume").alias("v1")).join(second.select(*keys, F.col("volume").alias("v2")), keys)
    if combined is None:
        return rows.select(*keys, radius_of_volume(F.col("v1") - F.col("v2")).alias("rv"))
    rows = rows.join(combined.select(*keys, F.col("volume").alias("v3")), keys)
    return rows.select(*keys, radius_of_volume(F.col("v1") + F.col("v2") - F.col("v3")).alias("rv"))


def with_ends(edges: DataFrame, vertices: DataFrame, keys: list[str] = PART) -> DataFrame:
    """``edges(keys, i, j)`` with the ends' coordinates ``px .. qz``."""
    points = vertices.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("vertex_id", "x", "y", "z"))).alias("vs"))
    own = edges.groupBy(*keys).agg(F.collect_list(F.struct("i", "j")).alias("es"))

    def ends(e: Column) -> Column:
        p, q = F.element_at("vs", (e["i"] + 1).cast("int")), F.element_at("vs", (e["j"] + 1).cast("int"))
        return F.struct(e["i"].alias("i"), e["j"].alias("j"), *fields(p).columns("p"), *fields(q).columns("q"))

    return own.join(points, keys).select(*keys, F.inline(F.transform("es", ends)))


def part_score(edges: DataFrame, vertices: DataFrame, keys: list[str] = PART) -> DataFrame:
    """``keys, score``: total length of the visibility edges of each part that has any."""
    return with_ends(edges, vertices, keys).groupBy(*keys).agg(F.sum(distance(vec("p"), vec("q"))).alias("score"))


def first_best(rows: DataFrame, keys: list[str], ordinal: str, value: str, largest: bool = True) -> DataFrame:
    """``keys, ordinal, value`` of the best row of each group; of equal values the smallest ordinal. Null values don't count."""
    v = F.col(value)
    best = F.max_by(F.struct(ordinal, value), F.struct(v if largest else -v, -F.col(ordinal)))
    return rows.where(v.isNotNull()).groupBy(*keys).agg(best.alias("best")).select(*keys, f"best.{ordinal}", f"best.{value}")


def concavity(corner_rows: DataFrame, hull_corner_rows: DataFrame, hausdorff: DataFrame, keys: list[str] = PART) -> DataFrame:
    """``keys, selection, final``: max(0.3 rv, Hausdorff), by which parts are chosen, and the Hausdorff distance alone."""
    rv = volume_radius(measures(corner_rows, keys), measures(hull_corner_rows, keys), keys=keys)
    rows = rv.join(hausdorff, keys)
    return rows.select(*keys, F.greatest(F.col("rv") * 0.3, "hausdorff").alias("selection"), F.col("hausdorff").alias("final"))


def mesh_digest(vertices: DataFrame, triangles: DataFrame, scale: int = 1_000_000, keys: list[str] = MESH) -> DataFrame:
    """``keys, digest``: SHA-256 of counts, coordinates (in units of 1/scale) and indices, in order."""

    def whole(axis: str) -> Column:
        return F.round(F.col(axis) * scale).cast("bigint").cast("string")

    order = [k for k in ("part_id",) if k not in keys]
    points = vertices.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(*order, "vertex_id", F.concat_ws(" ", *map(whole, "xyz")).alias("t")))).alias("vs")
    )
    faces = triangles.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(*order, "triangle_id", F.concat_ws(" ", "v0", "v1", "v2").alias("t")))).alias("ts")
    )
    text = F.concat_ws(
        "|", F.size("vs").cast("string"), F.size("ts").cast("string"), F.array_join(F.transform("vs", lambda v: v["t"]), ","), F.array_join(F.transform("ts", lambda t: t["t"]), ",")
    )
    return points.join(faces, keys).select(*keys, F.sha2(text, 256).alias("digest"))


def mesh_hash(vertices: DataFrame, triangles: DataFrame, keys: list[str] = MESH) -> DataFrame:
    """``keys, hash``: a 64-bit fold over the exact bits of coordinates and indices, in order."""
    points = vertices.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("vertex_id", "x", "y", "z"))).alias("vs"))
    faces = triangles.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("triangle_id", "v0", "v1", "v2"))).alias("ts"))
    return points.join(faces, keys).select(*keys, F.xxhash64("vs", "ts").alias("hash"))


