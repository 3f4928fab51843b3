"""Joins, rankings and rewrites on mesh tables: all but voxels is declared and runs in the JVM."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meshlake import kernels
from meshlake.functions.geometry import (
    Vec, bisector, distance, fields, plane, vec, with_hits, with_point_triangle,
)
from meshlake.operators.aggregates import MESH, PART, dealt, with_ends
from meshlake.sources.meshes import settled

#: Points of a mesh up to which its pairs are tested against all its triangles.
FEW = 64

# --- joins -----------------------------------------------------------------


def undirected(u: str, v: str) -> list[Column]:
    return [F.least(u, v).alias("lo"), F.greatest(u, v).alias("hi")]


def half_edges(triangles: DataFrame, keys: list[str] = MESH) -> DataFrame:
    """``keys, triangle_id, k, u, v``: the three directed sides of each triangle."""
    sides = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"v{k}").alias("u"), F.col(f"v{(k + 1) % 3}").alias("v")) for k in range(3)])
    return triangles.select(*keys, "triangle_id", F.inline(sides))


def adjacency(triangles: DataFrame, keys: list[str] = MESH) -> DataFrame:
    """``keys, t1, t2``: ordered pairs of triangles that share a side, each once."""
    sides = half_edges(triangles, keys).select(*keys, "triangle_id", *undirected("u", "v")).distinct()
    one, two = sides.withColumnRenamed("triangle_id", "t1"), sides.withColumnRenamed("triangle_id", "t2")
    return one.join(two, [*keys, "lo", "hi"]).where("t1 <> t2").select(*keys, "t1", "t2").distinct()


def vertex_pairs(vertices: DataFrame, keys: list[str] = MESH, only_new: bool = False) -> DataFrame:
    """``keys, i, j, px .. qz`` with i < j. ``only_new``: at least one of them is new (a null flag counts as new)."""
    new = [F.coalesce("is_new", F.lit(True)).alias("new")] if only_new else []
    rows = dealt(vertices.select(*keys, "vertex_id", "x", "y", "z", *[c.alias("new") for c in new]), keys)
    a = rows.select(*keys, F.col("vertex_id").alias("i"), *vec().columns("p"), *[F.col("new").alias("new_i") for _ in new])
    b = rows.select(*keys, F.col("vertex_id").alias("j"), *vec().columns("q"), *[F.col("new").alias("new_j") for _ in new])
    pairs = a.join(b, keys).where("i < j")
    return pairs.where("new_i OR new_j").drop("new_i", "new_j") if only_new else pairs


def _cells_of_boxes(rows: DataFrame, ends: list[tuple[str, ...]], cell: str = "cell") -> DataFrame:
    """``rows`` once for each cell (``kx, ky, kz``) of the size in column ``cell`` that the box around the points ``ends`` meets; one more to each side for rounding."""
    for axis in "xyz":
        at = [F.col(f"{p}{axis}") for (p,) in ends]
        low, high = F.floor(F.least(*at) / F.col(cell) - 1e-9), F.floor(F.greatest(*at) / F.col(cell) + 1e-9)
        rows = rows.withColumn(f"k{axis}", F.explode(F.sequence(low, high)))
    return rows


def _cells_of_segments(pairs: DataFrame) -> DataFrame:
    """Segments p-q once for each cell that they pass: cut in slabs along the axis in which they are longest, a piece meets few cells in the other two."""
    p, q, cell = F.array("px", "py", "pz"), F.array("qx", "qy", "qz"), F.col("cell")
    size = [F.abs(F.col(f"q{a}") - F.col(f"p{a}")) for a in "xyz"]
    rows = pairs.withColumn("_axis", F.when((size[0] >= size[1]) & (size[0] >= size[2]), 0).when(size[1] >= size[2], 1).otherwise(2))
    rows = rows.withColumns({"_p": F.get(p, F.col("_axis")), "_q": F.get(q, F.col("_axis"))})
    rows = rows.withColumn("_k", F.explode(F.sequence(F.floor(F.least("_p", "_q") / cell - 1e-9), F.floor(F.greatest("_p", "_q") / cell + 1e-9))))

    def at(k: Column) -> Column:
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide(k * cell - F.col("_p"), F.col("_q") - F.col("_p")), F.lit(0.0))))

    rows = rows.withColumns({"_t0": at(F.col("_k")), "_t1": F.when(F.col("_p") == F.col("_q"), 1.0).otherwise(at(F.col("_k") + 1))})
    for n, axis in enumerate("xyz"):
        start, along = F.col(f"p{axis}"), F.col(f"q{axis}") - F.col(f"p{axis}")
        s, t = start + along * F.col("_t0"), start + along * F.col("_t1")
        few = F.sequence(F.floor(F.least(s, t) / cell - 1e-6), F.floor(F.greatest(s, t) / cell + 1e-6))
        rows = rows.withColumn(f"k{axis}", F.explode(F.when(F.col("_axis") == n, F.array("_k")).otherwise(few)))
    return rows.drop("_axis", "_p", "_q", "_k", "_t0", "_t1")


def blocked(pairs: DataFrame, corner_rows: DataFrame, keys: list[str] = MESH) -> DataFrame:
    """``keys, i, j`` of pairs whose segment crosses a triangle.

    A join by cells: a triangle is put in all cells that its box meets, a segment in those that it passes,
    and only what shares a cell is tested. Cells are as large as the mesh's triangles are on average, but not
    smaller than a 64th of the mesh.
    """
    a, b, c = vec("a"), vec("b"), vec("c")
    ends = [("a",), ("b",), ("c",)]
    extent = [F.greatest(*[F.col(f"{p}{x}") for (p,) in ends]) - F.least(*[F.col(f"{p}{x}") for (p,) in ends]) for x in "xyz"]
    span = [F.max(F.greatest(*[F.col(f"{p}{x}") for (p,) in ends])) - F.min(F.least(*[F.col(f"{p}{x}") for (p,) in ends])) for x in "xyz"]
    sizes = corner_rows.groupBy(*keys).agg(F.greatest(F.avg(F.greatest(*extent)), F.greatest(*span) / 64, F.lit(1e-9)).alias("cell"))
    held = _cells_of_boxes(corner_rows.join(sizes, keys).select(*keys, "cell", *a.columns("a"), *b.columns("b"), *c.columns("c")), ends).drop("cell")
    p, q = vec("p"), vec("q")
    sent = _cells_of_segments(pairs.join(sizes, keys)).select(*keys, "i", "j", *p.columns("p"), *q.columns("q"), "kx", "ky", "kz")
    near = F.lit(True)
    for k in range(3):
        near = near & (F.least(p[k], q[k]) <= F.greatest(a[k], b[k], c[k])) & (F.greatest(p[k], q[k]) >= F.least(a[k], b[k], c[k]))
    hits = with_hits(sent.join(held, [*keys, "kx", "ky", "kz"]).where(near))
    # Not a filter: that would be moved below the steps of the test, which would then be written out as one expression.
    return hits.select(*keys, F.inline(F.when(F.col("hit"), F.array(F.struct("i", "j"))))).distinct()


def visibility_edges(vertices: DataFrame, own: DataFrame, cage: DataFrame, keys: list[str] = MESH, only_new: bool = False) -> DataFrame:
    """``keys, i, j``: pairs whose segment crosses the cage but not the mesh itself. ``own`` and ``cage`` are corner rows.

    Meshes of up to ``FEW`` points are gathered in a row each and tested many at a time (:func:`meshlake.kernels.seen_pairs`), where they lie:
    pairs are not dealt out. Those of larger meshes meet triangles by cells.
    """
    large = vertices.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > FEW).select(*keys)
    if not large.limit(1).count():
        return _seen(vertices, own, cage, keys, only_new)
    small = _seen(*(df.join(large, keys, "left_anti") for df in (vertices, own, cage)), keys, only_new)
    vertices, own, cage = (df.join(large, keys, "left_semi") for df in (vertices, own, cage))
    pairs = vertex_pairs(vertices, keys, only_new)
    outside = pairs.join(blocked(pairs, cage, keys), [*keys, "i", "j"], "left_semi")
    return outside.join(blocked(outside, own, keys), [*keys, "i", "j"], "left_anti").select(*keys, "i", "j").unionByName(small)


def _seen(vertices: DataFrame, own: DataFrame, cage: DataFrame, keys: list[str], only_new: bool) -> DataFrame:
    corner, n = [f"{p}{x}" for p in "abc" for x in "xyz"], len(keys)
    new = F.coalesce("is_new", F.lit(True)) if only_new else F.lit(True)

    def gathered(df: DataFrame, name: str, *columns: Column | str) -> DataFrame:
        return df.groupBy(*keys).agg(F.collect_list(F.struct(*columns)).alias(name))

    rows = gathered(vertices, "points", F.col("vertex_id").cast("long").alias("id"), new.alias("new"), "x", "y", "z").join(gathered(cage, "cage", *corner), keys)
    rows = rows.join(gathered(own, "own", *corner), keys, "left").select(*keys, "points", "own", "cage")

    kind = T.IntegerType() if isinstance(vertices.schema["vertex_id"].dataType, T.IntegerType) else T.LongType()

    def listed(column: pa.Array, names: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of a column of lists of structs: where each begins, how many it has, and the structs' numbers as rows."""
        count = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        fields = column.flatten().flatten()
        return np.cumsum(count) - count, count, np.stack([x.to_numpy(zero_copy_only=False).astype(float) for x in fields[-len(names) :]], axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            points, own, cage = (listed(batch.column(n + k), names) for k, names in enumerate((list("xyz"), corner, corner)))
            ids, new = (x.to_numpy(zero_copy_only=False) for x in batch.column(n).flatten().flatten()[:2])
            sizes, which = np.unique(np.stack([x[1] for x in (points, own, cage)], axis=1), axis=0, return_inverse=True)
            for shape, (n_points, n_own, n_cage) in enumerate(sizes.tolist()):
                row = np.flatnonzero(which.ravel() == shape)
                at = points[0][row, None] + np.arange(n_points)
                at = np.take_along_axis(at, np.argsort(ids[at], axis=1, kind="stable"), axis=1)
                held = [x[2][x[0][row, None] + np.arange(m)].reshape(len(row), m, 3, 3) for x, m in ((own, n_own), (cage, n_cage))]
                mesh, i, j = kernels.seen_pairs(points[2][at], *held)
                i, j = at[mesh, i], at[mesh, j]
                kept = (new[i] | new[j]) & (ids[i] < ids[j])
                mesh, i, j = row[mesh[kept]], ids[i[kept]], ids[j[kept]]
                i, j = (pa.array(x.astype(np.int32 if isinstance(kind, T.IntegerType) else np.int64)) for x in (i, j))
                yield pa.RecordBatch.from_arrays([*[batch.column(k).take(pa.array(mesh)) for k in range(n)], i, j], names=[*keys, "i", "j"])

    return rows.mapInArrow(run, T.StructType([*[rows.schema[c] for c in keys], T.StructField("i", kind), T.StructField("j", kind)]))


def _in_cells(points: DataFrame, per_cell: int, keys: list[str], most: int = 1 << 20) -> DataFrame:
    """``points`` with the cell (``cx, cy, cz``) of each in its own group's grid of about ``per_cell`` points to a cell, ``most`` cells to an axis."""
    box = points.groupBy(*keys).agg(F.count("*").alias("_n"), *[F.min(a).alias(f"_l{a}") for a in "xyz"], *[(F.max(a) - F.min(a)).alias(f"_e{a}") for a in "xyz"])
    side = F.least(F.greatest(F.floor(F.pow(F.col("_n") / per_cell, F.lit(1 / 3))), F.lit(1)), F.lit(most))
    box = box.select(*keys, *[f"_l{a}" for a in "xyz"], (F.greatest(*[F.col(f"_e{a}") for a in "xyz"], F.lit(1e-12)) / side).alias("cell"))
    rows = points.join(box, keys)
    return rows.select(*points.columns, "cell", *[F.floor((F.col(a) - F.col(f"_l{a}")) / F.col("cell")).alias(f"c{a}") for a in "xyz"])


def nearest_points(points: DataFrame, k: int, keys: list[str] = PART, per_cell: int = 8) -> DataFrame:
    """``keys, sample_id, rank, target_id, d2``: the ``k`` nearest other points of each point of its group; ties to the smaller id.

    ``points(keys, vertex_id, x, y, z)``, ids unique in a group; see :mod:`meshlake.operators.blocks`, whose blocks have 64 times ``per_cell`` points.
    """
    from meshlake.operators import blocks

    return blocks.nearest_points(points.select(*keys, F.col("vertex_id").cast("bigint").alias("id"), "x", "y", "z"), k, keys, 64 * per_cell)


def nearest_targets(queries: DataFrame, targets: DataFrame, k: int, keys: list[str] = MESH, per_cell: int = 8, others: bool = False) -> DataFrame:
    """``keys, sample_id, rank, target_id, d2``: the ``k`` nearest targets of each query of its group; ties to the smaller id.

    Both tables are ``keys, id, x, y, z``; ``others``: a target with the query's id doesn't count. Targets are looked for in the cells around a query's, in
    rings of cells: a round looks at the rings up to one cell farther than the last. What lies outside of these is at least so many
    cells away; a query whose k-th neighbour is nearer than that is done and sits the next rounds out.
    """
    asked = queries.select(*keys, "id", "x", "y", "z", F.lit(True).alias("asks"))
    rows = _in_cells(asked.unionByName(targets.select(*keys, "id", "x", "y", "z", F.lit(False).alias("asks"))), per_cell * 2 if others else per_cell, keys)
    held = rows.where("NOT asks").select(*keys, F.col("id").alias("target_id"), *vec().columns("q"), "cx", "cy", "cz")
    most = rows.groupBy(*keys).agg(F.greatest(*[F.max(f"c{a}") - F.min(f"c{a}") for a in "xyz"]).alias("most"))
    waiting = rows.where("asks").join(most, keys).select(*keys, F.col("id").alias("sample_id"), *vec().columns("p"), "cx", "cy", "cz", "cell", "most")
    rounds, far = [], int(most.agg(F.coalesce(F.max("most"), F.lit(0))).first()[0])
    reach = min(1, far)
    if far <= 1:  # All groups are small, of two cells to an axis at most: all meet all, without cells.
        return _ranked(waiting.drop("cx", "cy", "cz").join(held.drop("cx", "cy", "cz"), keys), k, keys, others)
    while True:
        ring = F.array(*[F.struct(*[F.lit(v).alias(f"d{a}") for a, v in zip("xyz", d, strict=True)]) for d in product(range(-reach, reach + 1), repeat=3)])
        asked = waiting.select("*", F.inline(ring)).withColumns({f"c{a}": F.col(f"c{a}") + F.col(f"d{a}") for a in "xyz"}).drop("dx", "dy", "dz")
        found = _ranked(asked.join(held, [*keys, "cx", "cy", "cz"]), k, keys, others)
        if reach >= far:
            return _union([*rounds, found])
        whole = F.col("most") <= reach  # there are no cells beyond
        near = F.pow(F.col("cell") * reach, F.lit(2.0)) - 1e-8
        done = found.groupBy(*keys, "sample_id").agg(F.max("rank").alias("got"), F.max("d2").alias("last"))
        state = waiting.join(done, [*keys, "sample_id"], "left").withColumn("done", whole | F.coalesce((F.col("got") >= k) & (F.col("last") < near), F.lit(False)))
        # Tables, so that rounds don't repeat each other's work.
        found, state = settled(found), settled(state)
        rounds.append(found.join(state.where("done").select(*keys, "sample_id"), [*keys, "sample_id"], "left_semi"))
        waiting = state.where("NOT done").drop("got", "last", "done")
        if not waiting.limit(1).count():
            return _union(rounds)
        reach = min(far, 2 * reach)


def _ranked(met: DataFrame, k: int, keys: list[str], others: bool) -> DataFrame:
    """The ``k`` nearest of the targets that each query met."""
    off = vec("p").minus(vec("q"))
    met = met.where("sample_id <> target_id") if others else met
    order = Window.partitionBy(*keys, "sample_id").orderBy("d2", "target_id")
    found = met.withColumn("d2", F.round(off.dot(off), 9)).withColumn("rank", F.row_number().over(order))
    return found.where(F.col("rank") <= k).select(*keys, "sample_id", "rank", "target_id", "d2")


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def part_distances(points: DataFrame, keys: list[str] = MESH, size: int = 512) -> DataFrame:
    """``keys, p1, p2, distance`` (p1 < p2): the least distance between points of two parts.

    Finite points meet by blocks of ``size``, see :func:`meshlake.operators.blocks.part_squares`. How far parts without such are from others
    (infinitely, NaN or null) depends only on which coordinates aren't finite, so one point of each kind stands for all.
    """
    from meshlake.operators import blocks

    finite = {a: F.abs(F.col(a).cast("double")) < float("inf") for a in "xyz"}  # NaN is more than all others
    kinds = points.select(*keys, "part_id", *[F.when(finite[a], 0.0).otherwise(F.col(a).cast("double")).alias(a) for a in "xyz"]).distinct()
    one = kinds.select(*keys, F.col("part_id").alias("p1"), *[F.col(a).alias(f"p{a}") for a in "xyz"])
    two = kinds.select(*keys, F.col("part_id").alias("p2"), *[F.col(a).alias(f"q{a}") for a in "xyz"])
    pairs = one.join(two, keys).where("p1 < p2").groupBy(*keys, "p1", "p2").agg(F.min(distance(vec("p"), vec("q"))).alias("distance"))
    usable = points.where(finite["x"] & finite["y"] & finite["z"] & F.col("part_id").isNotNull())
    met = blocks.part_squares(usable.select(*keys, F.col("part_id").cast("bigint").alias("id"), *[F.col(a).cast("double").alias(a) for a in "xyz"]), keys, size)
    found = pairs.join(met, [*keys, "p1", "p2"], "left")
    return found.select(*keys, "p1", "p2", F.when(F.col("distance") == 0, F.sqrt("d2")).otherwise(F.col("distance")).alias("distance"))


def inherit_edges(edges: DataFrame, renamed: DataFrame, keys: list[str] = MESH) -> DataFrame:
    """Edges carried over to new vertex numbers; ``renamed(keys, old_id, new_id)``. An edge that loses an end goes."""
    first = renamed.select(*keys, F.col("old_id").alias("i"), F.col("new_id").alias("ni"))
    second = renamed.select(*keys, F.col("old_id").alias("j"), F.col("new_id").alias("nj"))
    rows = edges.join(first, [*keys, "i"]).join(second, [*keys, "j"])
    return rows.select(*keys, F.least("ni", "nj").alias("i"), F.greatest("ni", "nj").alias("j"))


def close_parts(points: DataFrame, threshold: float, keys: list[str] = MESH) -> DataFrame:
    """``keys, p1, p2`` (p1 < p2): parts with two points nearer than ``threshold``.

    A range join as an equi-join: points fall in cells as large as the threshold, one side is
    put in all 27 cells around its own, and only points in the same cell are compared.
    """
    cells = {f"c{a}": F.floor(F.col(a) / threshold) for a in "xyz"}
    a = points.withColumns(cells).select(*keys, F.col("part_id").alias("p1"), *vec().columns("p"), *cells)
    around = F.array(*[F.struct(*[(F.col(f"c{x}") + d).alias(f"n{x}") for x, d in zip("xyz", ds, strict=True)]) for ds in product((-1, 0, 1), repeat=3)])
    b = points.withColumns(cells).select(*keys, F.col("part_id").alias("p2"), *vec().columns("q"), F.inline(around))
    b = b.select(*keys, "p2", "qx", "qy", "qz", *[F.col(f"n{x}").alias(f"c{x}") for x in "xyz"])
    d = vec("p").minus(vec("q"))
    near = a.join(b, [*keys, "cx", "cy", "cz"]).where("p1 < p2").where(d.dot(d) < threshold * threshold)
    return near.select(*keys, "p1", "p2").distinct()


def boxes_overlap(boxes: DataFrame, threshold: float, keys: list[str] = MESH, side: int = 8) -> DataFrame:
    """``keys, p1, p2``: parts whose boxes are nearer than ``threshold`` on every axis.

    A join by cells, as large as a group's boxes are on average, but not smaller than a ``side``-th of the group: boxes, widened by
    half the threshold, are put in all cells that they meet, and only those that share one are compared.
    """
    names = [f"{m}_{a}" for m in ("min", "max") for a in "xyz"]
    extent = F.greatest(*[F.col(f"max_{a}") - F.col(f"min_{a}") for a in "xyz"])
    span = F.greatest(*[F.max(f"max_{a}") - F.min(f"min_{a}") for a in "xyz"])
    sizes = boxes.groupBy(*keys).agg(F.greatest(F.avg(extent) + threshold, (span + threshold) / side, F.lit(1e-9)).alias("cell"))
    rows = boxes.join(sizes, keys).select(*keys, "part_id", *names, "cell")
    for a in "xyz":
        low, high = (F.floor((F.col(f"{m}_{a}") + s * threshold / 2) / F.col("cell") + s * 1e-9) for m, s in (("min", -1), ("max", 1)))
        rows = rows.withColumn(f"k{a}", F.explode(F.sequence(low, high)))
    one = rows.select(*keys, F.col("part_id").alias("p1"), *[F.col(c).alias(f"{c}_1") for c in names], "kx", "ky", "kz")
    two = rows.select(*keys, F.col("part_id").alias("p2"), *[F.col(c).alias(f"{c}_2") for c in names], "kx", "ky", "kz")
    met = one.join(two, [*keys, "kx", "ky", "kz"]).where("p1 < p2")
    for a in "xyz":
        met = met.where((F.col(f"min_{a}_1") - F.col(f"max_{a}_2") < threshold) & (F.col(f"min_{a}_2") - F.col(f"max_{a}_1") < threshold))
    return met.select(*keys, "p1", "p2").distinct()


def adjacent_by_cut(triangles: DataFrame, keys: list[str] = MESH) -> DataFrame:
    """``keys, p1, p2``: parts that hold the two sides (+t and -t) of a cut face."""
    faces = triangles.where("interface <> 0").select(*keys, "part_id", "interface").distinct()
    one = faces.select(*keys, F.col("part_id").alias("p1"), F.col("interface").alias("token"))
    two = faces.select(*keys, F.col("part_id").alias("p2"), (-F.col("interface")).alias("token"))
    return one.join(two, [*keys, "token"]).where("p1 < p2").select(*keys, "p1", "p2").distinct()


def plane_scores(planes: DataFrame, edge_ends: DataFrame, flat_factor: float = 2.0, keys: list[str] = MESH) -> DataFrame:
    """``keys, plane_id, score``: length of the edges that a plane strictly separates, times ``flat_factor`` for flat planes; 0 if none."""
    cutter = plane()
    opposite = cutter.side(vec("p")) * cutter.side(vec("q")) < 0
    scored = planes.join(edge_ends, keys, "left").groupBy(*keys, "plane_id").agg(
        F.coalesce(F.sum(F.when(opposite, distance(vec("p"), vec("q")))), F.lit(0.0)).alias("raw"), F.first("is_flat").alias("is_flat")
    )
    return scored.select(*keys, "plane_id", F.when(F.col("is_flat"), F.col("raw") * flat_factor).otherwise(F.col("raw")).alias("score"))


# --- rankings, deduplication, compaction -------------------------------------


def bisector_planes(edges: DataFrame, vertices: DataFrame, keys: list[str] = PART) -> DataFrame:
    """``keys, i, j, a, b, c, d`` of the plane that bisects each edge; edges shorter than 1e-6 have none."""
    p, q = vec("p"), vec("q")
    rows = with_ends(edges, vertices, keys).where(distance(p, q) >= 1e-6)
    return rows.select(*keys, "i", "j", *[c.alias(n) for n, c in zip("abcd", bisector(p, q), strict=True)])


def top_by_area(surfaces: DataFrame, limit: int = 40, keys: list[str] = MESH) -> DataFrame:
    """The ``limit`` largest surfaces of each mesh, ties to the smaller id."""
    order = Window.partitionBy(*keys).orderBy(F.desc("area"), "surface_id")
    return surfaces.withColumn("at", F.row_number().over(order)).where(F.col("at") <= limit).drop("at")


def set_bits(words: DataFrame, keys: list[str] = MESH, width: int = 32) -> DataFrame:
    """``keys, at, item``: positions of the set bits of ``words(keys, word, bits)``, numbered in order: a stable compaction."""
    items = words.select(*keys, "word", "bits", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("k"))
    items = items.where(F.getbit("bits", "k") == 1).select(*keys, (F.col("word") * width + F.col("k")).cast("bigint").alias("item"))
    return items.withColumn("at", (F.row_number().over(Window.partitionBy(*keys).orderBy("item")) - 1).cast("bigint"))


def first_occurrence(triangles: DataFrame, keys: list[str] = PART) -> DataFrame:
    """``keys, old_id, new_id``: vertices numbered by their first corner, in order of triangles."""
    corner_ids = F.array(*[F.struct((F.col("triangle_id") * 3 + k).alias("at"), F.col(f"v{k}").alias("old_id")) for k in range(3)])
    first = triangles.select(*keys, F.inline(corner_ids)).groupBy(*keys, "old_id").agg(F.min("at").alias("at"))
    return first.select(*keys, "old_id", (F.row_number().over(Window.partitionBy(*keys).orderBy("at")) - 1).alias("new_id"))


def unique_edges(edges: DataFrame, keys: list[str] = MESH) -> DataFrame:
    """Of edges ``keys, at, u, v`` that join the same two points, the first, in the direction it has."""
    first = F.min(F.struct("at", "u", "v")).alias("e")
    return edges.groupBy(*keys, *undirected("u", "v")).agg(first).select(*keys, "e.at", "e.u", "e.v")


def compare_by_position(one: DataFrame, two: DataFrame, order: list[str], value: str, keys: list[str] = MESH) -> DataFrame:
    """``keys, n_one, n_two, differing, largest``: sorted lists held against each other by position.

    A row that only one list has counts as differing.
    """

    def ranked(df: DataFrame, tag: str) -> DataFrame:
        at = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        return df.select(*keys, at.alias("at"), F.struct(*order).alias(f"place_{tag}"), F.col(value).alias(f"value_{tag}"))

    rows = ranked(one, "1").join(ranked(two, "2"), [*keys, "at"], "full_outer")
    same = F.coalesce(F.col("place_1") == F.col("place_2"), F.lit(False))
    return rows.groupBy(*keys).agg(
        F.count("place_1").alias("n_one"), F.count("place_2").alias("n_two"), F.sum(F.when(same, 0).otherwise(1)).alias("differing"),
        F.max(F.when(same, F.abs(F.col("value_1") - F.col("value_2")))).alias("largest"),
    )


# --- clipping and merging ----------------------------------------------------


def clip_prepare(corner_rows: DataFrame, planes: DataFrame, keys: list[str] = MESH) -> DataFrame:
    """``keys, triangle_id, s0, s1, s2, side, mask`` and the cut points ``i0x .. i2z`` of each triangle against its mesh's plane.

    ``side`` is 1 or -1 where the triangle stays whole on one side, 0 where the plane crosses it;
    only then the mask tells which sides (bits 1, 2, 4) are cut, and the points are set.
    """
    cutter, p = plane("plane_"), [vec("a"), vec("b"), vec("c")]
    named = planes.select(*keys, *[F.col(k).alias(f"plane_{k}") for k in "abcd"])
    rows = corner_rows.join(named, keys)
    rows = rows.withColumns({f"s{k}": cutter.side(p[k]) for k in range(3)})
    flat = (F.col("s0") == 0) & (F.col("s1") == 0) & (F.col("s2") == 0)
    rows = rows.withColumn("flat", F.when(flat, cutter.cut_side(*p)))
    rows = rows.withColumns({f"s{k}": F.coalesce("flat", f"s{k}") for k in range(3)})
    sides = F.array("s0", "s1", "s2")
    rows = rows.withColumn("side", F.when(F.array_min(sides) >= 0, 1).when(F.array_max(sides) <= 0, -1).otherwise(0))
    cuts = [cutter.cut(p[k], p[(k + 1) % 3]) for k in range(3)]
    crossed = F.col("side") == 0
    mask = sum((F.when(inside, 1 << k).otherwise(0) for k, (_, inside) in enumerate(cuts)), F.lit(0))
    points = [F.when(crossed & inside, c).alias(f"i{k}{axis}") for k, (at, inside) in enumerate(cuts) for c, axis in zip(at, "xyz", strict=True)]
    return rows.select(*keys, "triangle_id", "s0", "s1", "s2", "side", F.when(crossed, mask).otherwise(0).alias("mask"), *points)


def cap_tokens(caps: DataFrame, split: str = "split", at: str = "cap_id") -> DataFrame:
    """Adds ``interface``: split * 2^32 + cap + 1, negative on the negative side (``side`` is 1 or -1)."""
    token = F.shiftleft(F.col(split).cast("bigint"), 32) + F.col(at) + 1
    return caps.withColumn("interface", token * F.col("side"))


def outward(corner_rows: DataFrame, triangles: DataFrame, vertices: DataFrame, keys: list[str] = MESH) -> DataFrame:
    """Triangles wound so that normals point away from the mean of all vertices of their mesh."""
    centre = vertices.groupBy(*keys).agg(*[F.avg(a).alias(f"m{a}") for a in "xyz"])
    a, b, c = vec("a"), vec("b"), vec("c")
    rows = corner_rows.join(centre, keys)
    inward = b.minus(a).cross(c.minus(a)).dot(vec("m").minus(a)) > 0
    rows = rows.select(*keys, "triangle_id", inward.alias("inward"))
    both = triangles.join(rows, [*keys, "triangle_id"])
    return both.select(
        *keys, "triangle_id", "v0",
        F.when(F.col("inward"), F.col("v2")).otherwise(F.col("v1")).alias("v1"),
        F.when(F.col("inward"), F.col("v1")).otherwise(F.col("v2")).alias("v2"),
    )


def cap_frames(border: DataFrame, planes: DataFrame, keys: list[str] = MESH) -> DataFrame:
    """``keys, swapped, tx, ty, tz, r0x .. r2z``: origin and orthonormal axes of the plane that a border's points lie in.

    ``border(keys, at, x, y, z)``, ``planes(keys, a, b, c)``. The origin is the point at 0; the second point is the first
    more than 0.01 away from it, the third the first from 2 on that isn't in line with them. If their
    normal (not made a unit vector) points the way of the plane's, origin and third point change places; they don't if it
    is orthogonal to that. Borders without such points give no row.
    """
    whole, order = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("at")
    here = vec()

    def first(test: Column) -> Column:
        return F.min(F.when(test, F.struct("at", "x", "y", "z"))).over(whole)

    rows = border.select(*keys, "at", "x", "y", "z", F.row_number().over(order).alias("nth"))
    rows = rows.withColumn("p", first(F.col("nth") == 1))
    rows = rows.withColumn("q", first((F.col("nth") > 1) & (distance(fields(F.col("p")), here) > 0.01)))
    p, q = fields(F.col("p")), fields(F.col("q"))
    along, onwards = q.minus(p), here.minus(q)
    cosine = F.try_divide(along.dot(onwards), along.length() * onwards.length())
    bent = (F.col("nth") > 2) & (F.col("at") != F.col("q.at")) & (F.abs(F.abs(cosine) - 1) > 1e-6)
    rows = rows.withColumn("bent", F.coalesce(bent, F.lit(False))).where("bent")
    three = rows.groupBy(*keys).agg(F.min_by(F.struct("p", "q", F.struct("x", "y", "z").alias("r")), "at").alias("s"))
    three = three.select(*keys, *[F.col(f"s.{n}.{a}").alias(f"{n}{a}") for n in "pqr" for a in "xyz"]).join(planes, keys)
    p, q, r = (vec(n) for n in "pqr")
    # The sign needs no unit vector, whose rounding would decide where the normals are orthogonal.
    swap = q.minus(p).cross(r.minus(p)).dot(Vec(*[F.col(n) for n in "abc"])) > 0
    three = three.withColumn("swapped", F.coalesce(swap, F.lit(False)))
    origin = Vec(*[F.when(F.col("swapped"), c).otherwise(o) for c, o in zip(r, p, strict=True)])
    third = Vec(*[F.when(F.col("swapped"), o).otherwise(c) for c, o in zip(r, p, strict=True)])
    three = three.select(*keys, "swapped", *origin.columns("t"), *third.columns("u"), *q.columns("q"))
    t, u = vec("t"), vec("u")
    three = three.select("*", *t.minus(q).unit().columns("r0"))
    three = three.select("*", *vec("r0").cross(u.minus(t)).unit().columns("r2"))
    three = three.select("*", *vec("r0").cross(vec("r2")).unit().columns("r1"))
    return three.select(*keys, "swapped", *[f"{n}{a}" for n in ("t", "r0", "r1", "r2") for a in "xyz"])


def admitted(children: DataFrame, at_least: int = 10, keys: list[str] = MESH) -> DataFrame:
    """``keys, part_id, place``: of new parts ``keys, part_id, n_vertices``, those with enough points, in order."""
    order = Window.partitionBy(*keys).orderBy("part_id")
    return children.where(F.col("n_vertices") >= at_least).select(*keys, "part_id", F.row_number().over(order).alias("place"))


def merge_meshes(vertices: DataFrame, triangles: DataFrame, keys: list[str] = MESH) -> tuple[DataFrame, DataFrame]:
    """All parts of a mesh as one: vertex and triangle numbers are shifted by those of the parts before."""

    def shift(df: DataFrame, name: str) -> DataFrame:
        n = df.groupBy(*keys, "part_id").agg(F.count("*").alias("n"))
        before = Window.partitionBy(*keys).orderBy("part_id").rowsBetween(Window.unboundedPreceding, -1)
        return n.select(*keys, "part_id", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("int").alias(name))

    vo, to = shift(vertices, "v_shift"), shift(triangles, "t_shift")
    points = vertices.join(vo, [*keys, "part_id"]).select(*keys, (F.col("vertex_id") + F.col("v_shift")).alias("vertex_id"), "x", "y", "z")
    faces = triangles.join(vo, [*keys, "part_id"]).join(to, [*keys, "part_id"])
    token = F.col("interface") if "interface" in triangles.columns else F.lit(0).cast("bigint")
    return points, faces.select(
        *keys, (F.col("triangle_id") + F.col("t_shift")).alias("triangle_id"), *[(F.col(f"v{k}") + F.col("v_shift")).alias(f"v{k}") for k in range(3)], token.alias("interface")
    )


# --- distances, voxels -------------------------------------------------------


def nearest_samples(queries: DataFrame, targets: DataFrame, k: int = 10, keys: list[str] = MESH) -> DataFrame:
    """``keys, sample_id, qx, qy, qz, rank, target_id, triangle_id, d2``: the ``k`` nearest target samples of each query, ties to the smaller id.

    Both tables are ``keys, sample_id, x, y, z``, targets with a ``triangle_id``. By cells (:func:`nearest_targets`), so that not all meet all.
    """
    q, t = (df.select(*keys, F.col("sample_id").alias("id"), "x", "y", "z") for df in (queries, targets))
    found = nearest_targets(q, t, k, keys)
    named = found.join(targets.select(*keys, F.col("sample_id").alias("target_id"), "triangle_id"), [*keys, "target_id"])
    return named.join(queries.select(*keys, "sample_id", *vec().columns("q")), [*keys, "sample_id"])


def one_sided_hausdorff(queries: DataFrame, targets: DataFrame, target_corners: DataFrame, k: int = 10, keys: list[str] = MESH) -> DataFrame:
    """``keys, h``: over the queries, the largest distance to the nearest of the triangles that their ``k`` nearest samples lie on.

    A distance above 10 is replaced by that to the nearest sample; what isn't finite counts as 0.
    """
    near = nearest_samples(queries, targets, k, keys).join(target_corners, [*keys, "triangle_id"])
    near = with_point_triangle(near.withColumns({f"p{a}": F.col(f"q{a}") for a in "xyz"}))
    best = near.groupBy(*keys, "sample_id").agg(F.min("distance").alias("d"), F.sqrt(F.min("d2")).alias("nearest"))
    best = best.withColumn("d", F.when(F.col("d") > 10, F.col("nearest")).otherwise(F.col("d")))
    usable = F.when(F.isnan("d") | (F.col("d") == float("inf")), 0.0).otherwise(F.col("d"))
    return best.groupBy(*keys).agg(F.max(usable).alias("h"))


def hausdorff(a: DataFrame, a_corners: DataFrame, b: DataFrame, b_corners: DataFrame, k: int = 10, keys: list[str] = MESH) -> DataFrame:
    """``keys, hausdorff``: the larger of both directions, over given samples."""
    there = one_sided_hausdorff(a, b, b_corners, k, keys).withColumnRenamed("h", "h1")
    back = one_sided_hausdorff(b, a, a_corners, k, keys).withColumnRenamed("h", "h2")
    return there.join(back, keys).select(*keys, F.greatest("h1", "h2").alias("hausdorff"))


def voxelize(corner_rows: DataFrame, scale: float, keys: list[str] = MESH) -> DataFrame:
    """``keys, x, y, z, d2, triangle_id``: lattice points near the surface, with the nearest triangle.

    Coordinates are scaled in single precision. A triangle seeds the lattice points within
    sqrt(0.75) of it; it counts for these, their 26 neighbours, and the neighbours of the floor
    of its first corner (:func:`meshlake.kernels.near_lattice`, for a batch of triangles at a time). Of equal distances the smaller triangle id stays.
    """
    grid = {f"{p}{a}": (F.col(f"{p}{a}") * scale).cast("float").cast("double") for p in "abc" for a in "xyz"}
    corner, n = [f"{p}{a}" for p in "abc" for a in "xyz"], len(keys)
    rows = corner_rows.withColumns(grid).select(*keys, "triangle_id", *corner).dropna(subset=corner)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, ids = batch.columns[:n], batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64)
            if not len(ids):
                continue
            new = np.zeros(len(ids), dtype=bool)  # where another mesh begins
            for c in own:
                new[1:] |= pc.fill_null(pc.not_equal(c[1:], c[:-1]), True).to_numpy(zero_copy_only=False)
            mesh, row = np.cumsum(new), np.flatnonzero(np.concatenate([[True], new[1:]]))
            corners = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[n + 1 :]], axis=1)
            for tri, place, d2 in kernels.near_lattice(corners):
                # Distance, in billionths, and triangle in one number: its least is a plain hash aggregate. What doesn't fit is an error.
                if not ((d2 < 16).all() and (ids < 1 << 29).all()):
                    raise ValueError("a triangle id of 2^29 or more, or a distance above 4, in a voxelisation")
                low = np.floor(d2 * 1e9)
                best = ((low + (d2 * 1e9 - low >= 0.5)).astype(np.int64) << 29) | ids[tri]
                order = np.lexsort((best, place[:, 2], place[:, 1], place[:, 0], mesh[tri]))
                tri, place, best = tri[order], place[order], best[order]
                first = np.ones(len(tri), dtype=bool)
                first[1:] = (mesh[tri[1:]] != mesh[tri[:-1]]) | (place[1:] != place[:-1]).any(axis=1)
                at = pa.array(row[mesh[tri[first]]])
                yield pa.RecordBatch.from_arrays([*[c.take(at) for c in own], *[pa.array(place[first, k].astype(np.int32)) for k in range(3)], pa.array(best[first])], names=[*keys, *"xyz", "best"])

    made = T.StructType([*[rows.schema[c] for c in keys], *[T.StructField(a, T.IntegerType()) for a in "xyz"], T.StructField("best", T.LongType())])
    # Dealt by mesh: batches have few points twice, and what follows is done where a mesh's points are.
    best = dealt(rows.mapInArrow(run, made), keys).groupBy(*keys, "x", "y", "z").agg(F.min("best").alias("best"))
    d2, triangle = F.shiftright("best", 29) / 1e9, F.col("best").bitwiseAND(F.lit((1 << 29) - 1))
    return best.select(*keys, "x", "y", "z", d2.alias("d2"), triangle.cast("int").alias("triangle_id"))


def signed_distance(voxels: DataFrame, voxel_size: float) -> DataFrame:
    """Adds ``phi``: the square root of ``d2`` in units of length, negative where ``inside``."""
    far = F.sqrt(F.abs("d2")) * voxel_size
    return voxels.withColumn("phi", F.when(F.col("inside"), -far).otherwise(far))


def split_quads(quads: DataFrame, keys: list[str] = MESH) -> DataFrame:
    """``keys, triangle_id, v0, v1, v2``: quad (0, 1, 2, 3) as (0, 2, 1) and (0, 3, 2)."""
    halves = F.array(
        F.struct(F.lit(0).alias("h"), F.col("q0").alias("v0"), F.col("q2").alias("v1"), F.col("q1").alias("v2")),
        F.struct(F.lit(1).alias("h"), F.col("q0").alias("v0"), F.col("q3").alias("v1"), F.col("q2").alias("v2")),
    )
    return quads.select(*keys, "quad_id", F.inline(halves)).select(*keys, (F.col("quad_id") * 2 + F.col("h")).alias("triangle_id"), "v0", "v1", "v2")


def merge_costs(hull_volumes: DataFrame, combined: DataFrame, keys: list[str] = MESH) -> DataFrame:
    """``keys, p1, p2, cost``: 0.3 times the radius of what combining two hulls adds; ``combined(keys, p1, p2, volume)``."""
    from meshlake.functions.geometry import radius_of_volume

    one = hull_volumes.select(*keys, F.col("part_id").alias("p1"), F.col("volume").alias("v1"))
    two = hull_volumes.select(*keys, F.col("part_id").alias("p2"), F.col("volume").alias("v2"))
    rows = combined.join(one, [*keys, "p1"]).join(two, [*keys, "p2"])
    return rows.select(*keys, "p1", "p2", (radius_of_volume(F.col("v1") + F.col("v2") - F.col("volume")) * 0.3).alias("cost"))


# --- reports and sampling of rows ----------------------------------------------


def with_rank(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``rank`` (long, from 1) by ``order`` over all rows, and ``total``: dealt by range, ranked in each partition, shifted by the counts of those before.

    ``order`` should tell rows apart; of equal ones the order is arbitrary, but fixed: they are written down first.
    """
    dealt_rows = settled(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    counts = dealt_rows.groupBy("_part").agg(F.count("*").alias("_n"))  # a row for each partition
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("total"))
    at = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return dealt_rows.join(F.broadcast(shifts), "_part").withColumn("rank", at + F.col("_before")).drop("_part", "_before")


def quantiles(rows: DataFrame, column: str, at: list[float]) -> DataFrame:
    """``at, value``: exact quantiles with linear interpolation; only the rows next to each quantile are looked at after ranking."""
    ranked = with_rank(rows.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("value")), ["value"])
    wanted = F.array(*[F.lit(float(p)) for p in at])
    place = (F.col("total") - 1) * F.col("at")
    near = ranked.withColumn("at", F.explode(wanted)).withColumn("off", F.col("rank") - 1 - place).where("off > -1 AND off < 1")
    return near.groupBy("at").agg(F.sum(F.col("value") * (1 - F.abs("off"))).alias("value"))


def choose_rows(rows: DataFrame, strata: int, total: int, order: list[str], pick: Column) -> DataFrame:
    """A stratified choice: rows in near-equal bins by ``order``; each bin gives its share of ``total`` (the first ones one more), by ``pick``."""
    ranked = with_rank(rows, order)
    small, longer, at = F.floor(F.col("total") / strata), F.col("total") % strata, F.col("rank") - 1
    inside = longer * (small + 1)  # rows in the bins that have one more
    stratum = F.when(at < inside, F.floor(at / (small + 1))).otherwise(longer + F.floor((at - inside) / F.greatest(small, F.lit(1)))) + 1
    binned = ranked.withColumn("stratum", stratum.cast("int")).drop("rank", "total")
    nth = F.row_number().over(Window.partitionBy("stratum").orderBy(pick, *order))
    quota = F.lit(total // strata) + F.when(F.col("stratum") <= total % strata, 1).otherwise(0)
    # The first test bounds what is sorted of each bin; the second is each bin's own.
    return binned.withColumn("at", nth).where(F.col("at") <= total // strata + 1).where(F.col("at") <= quota).drop("at")


def work_buckets(sizes: DataFrame, size: str = "size") -> DataFrame:
    """Adds ``bucket``: the whole part of log2 of the size (0 for less than 2)."""
    return sizes.withColumn("bucket", F.floor(F.log2(F.greatest(F.col(size), F.lit(1)).cast("double"))).cast("bigint"))


def smooth_variant(vertices: DataFrame, normals: DataFrame, variants: int, amplitude: float = 0.02, seed: int = 42) -> DataFrame:
    """``mesh_id, variant, vertex_id, x, y, z``: each mesh ``variants`` times, scaled by axis and moved along its normals by a weighted sum of five sine waves.

    Waves have random directions, frequencies of 7 to 16 to the diagonal of the mesh's box, random phases, and normal weights whose
    absolute values sum to 1; factors lie within twice the amplitude of 1. All come from hashes of (seed, mesh, variant), so a
    run again gives the same meshes.
    """

    def uniform(*salt: int) -> Column:
        return (F.pmod(F.xxhash64(F.lit(seed), "mesh_id", "variant", *map(F.lit, salt)), F.lit(1 << 30)) + 0.5) / float(1 << 30)

    def normal(*salt: int) -> Column:
        return F.sqrt(-2 * F.log(uniform(*salt, 0))) * F.cos(6.283185307179586 * uniform(*salt, 1))

    box = vertices.groupBy("mesh_id").agg(*[(F.max(a) - F.min(a)).alias(f"d{a}") for a in "xyz"], *[((F.max(a) + F.min(a)) / 2).alias(f"m{a}") for a in "xyz"])
    copies = box.select("*", F.explode(F.sequence(F.lit(0), F.lit(variants - 1))).alias("variant")).withColumn("size", vec("d").length())
    # Drawn once for each copy of a mesh, not for each of its points.
    for k in range(5):
        copies = copies.withColumns({f"r{a}": normal(k, n) for n, a in enumerate("xyz")}).withColumns({f"w{k}{a}": c for a, c in zip("xyz", vec("r").unit(), strict=True)})
        copies = copies.withColumns({f"f{k}": 7 + 9 * uniform(k, 3), f"p{k}": 6.283185307179586 * uniform(k, 4), f"v{k}": normal(k, 5)})
    total = sum((F.abs(f"v{k}") for k in range(1, 5)), F.abs("v0"))
    copies = copies.withColumns({"all": total, **{f"s{a}": 1 + (uniform(9, n) - 0.5) * 4 * amplitude for n, a in enumerate("xyz")}}).drop("rx", "ry", "rz")
    rows = vertices.join(normals, ["mesh_id", "vertex_id"]).join(copies, "mesh_id")
    off = vec().minus(vec("m"))
    wave = sum((F.sin(F.try_divide(off.dot(vec(f"w{k}")), F.col("size")) * F.col(f"f{k}") + F.col(f"p{k}")) * F.col(f"v{k}") for k in range(5)), F.lit(0.0)) / F.col("all")
    moved = vec("m").plus(Vec(*[c * F.col(f"s{a}") for c, a in zip(off, "xyz", strict=True)])).plus(vec("n").times(wave * F.col("size") * amplitude))
    return rows.select("mesh_id", "variant", "vertex_id", *[c.alias(a) for c, a in zip(moved, "xyz", strict=True)])
