"""Sequential geometry per mesh or part, as grouped Arrow functions over mesh tables.

A mesh is the unit of work: both of its tables are dealt by mesh once, and a lost executor
only repeats its meshes. Results are long tables again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshlake import clipping
from meshlake import kernels as k
from meshlake.config import Config, validate
from meshlake.operators.aggregates import MESH, PART, dealt

PARTS = "mesh_id bigint, part_id int, n_parts int, concavity double, xyz array<double>, faces array<int>, tokens array<bigint>, edges array<int>"
#: Numbers of faces (three a face) that one step of clipping looks at.
AT_ONCE = 1 << 18


def _flat(vertices: DataFrame, triangles: DataFrame, keys: list[str], more: DataFrame | None) -> DataFrame:
    """``keys, points, faces[, more]``: a row for each mesh with its tables as flat arrays, dealt by mesh."""

    def flat(df: DataFrame, order: str, columns: list[str], name: str) -> DataFrame:
        rows = df.select(*keys, order, *columns).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, *columns))).alias("rows"))
        return rows.select(*keys, F.flatten(F.transform("rows", lambda r: F.array(*[r[c] for c in columns]))).alias(name))

    v, t = flat(vertices, "vertex_id", ["x", "y", "z"], "points"), flat(triangles, "triangle_id", ["v0", "v1", "v2"], "faces")
    rows = v.join(t, keys, "full_outer").select(*keys, "points", "faces")
    rows = rows if more is None else rows.join(more.select(*MESH, "more"), MESH, "left").select(*keys, "points", "faces", "more")
    return dealt(rows, keys)


def per_mesh(vertices: DataFrame, triangles: DataFrame, f: Callable[..., pd.DataFrame], schema: str, keys: list[str] = PART, more: DataFrame | None = None) -> DataFrame:
    """Apply ``f(key values, points, faces)`` to each mesh. A mesh that lacks points or faces gets empty arrays.

    ``more(mesh_id, more)`` is a further argument of ``f``, null for a mesh that has none; one row a mesh.

    Meshes become rows of two flat arrays in the JVM, and Python gets many of them at a time.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False, name=None):
                key, (points, faces, *further) = row[: len(keys)], row[len(keys) :]
                p = np.zeros((0, 3)) if points is None else np.array(points, dtype=float).reshape(-1, 3)
                t = k.NO_FACES if faces is None else np.array(faces, dtype=np.int64).reshape(-1, 3)
                out.append(f(key, p, t, *further))
            out = [x for x in out if len(x)]
            if out:
                yield pd.concat(out)

    return _flat(vertices, triangles, keys, more).mapInPandas(run, schema)


def per_points(vertices: DataFrame, f: Callable[..., pd.DataFrame], schema: str, keys: list[str]) -> DataFrame:
    """Apply ``f(key values, points)`` to the points of each mesh or part; Python gets many of them at a time."""
    rows = vertices.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("vertex_id", "x", "y", "z"))).alias("rows"))
    rows = rows.select(*keys, F.flatten(F.transform("rows", lambda r: F.array(*[r[c] for c in "xyz"]))).alias("points"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [f(row[:-1], np.array(row[-1], dtype=float).reshape(-1, 3)) for row in batch.itertuples(index=False, name=None)]
            out = [x for x in out if len(x)]
            if out:
                yield pd.concat(out)

    return dealt(rows, keys).mapInPandas(run, schema)


def packed(key: tuple, parts: list[k.Solid], concavity: float = 0.0) -> pd.DataFrame:
    rows = [
        (key[0], n, len(parts), concavity, p.points.ravel(), p.faces.ravel().astype(np.int32), p.face_tokens().astype(np.int64), np.asarray(p.edges).ravel().astype(np.int32))
        for n, p in enumerate(parts)
    ]
    return pd.DataFrame(rows, columns=["mesh_id", "part_id", "n_parts", "concavity", "xyz", "faces", "tokens", "edges"])


def part_vertices(parts: DataFrame) -> DataFrame:
    rows = parts.select(*PART, "xyz", F.explode(F.sequence(F.lit(0), (F.size("xyz") / 3).cast("int") - 1)).alias("vertex_id")).where("size(xyz) > 0")
    return rows.select(*PART, "vertex_id", *[F.element_at("xyz", F.col("vertex_id") * 3 + n + 1).alias(a) for n, a in enumerate("xyz")])


def part_triangles(parts: DataFrame) -> DataFrame:
    rows = parts.where("size(faces) > 0").select(*PART, "faces", "tokens", F.explode(F.sequence(F.lit(0), (F.size("faces") / 3).cast("int") - 1)).alias("triangle_id"))
    ids = [F.element_at("faces", F.col("triangle_id") * 3 + n + 1).alias(f"v{n}") for n in range(3)]
    return rows.select(*PART, "triangle_id", *ids, F.try_element_at("tokens", F.col("triangle_id") + 1).alias("interface"))


def part_corners(parts: DataFrame, *carry: str) -> DataFrame:
    """``mesh_id, part_id, carry, triangle_id, interface, ax .. cz``: corners from a part's own row, with no join."""

    def corners(i) -> Column:
        at = [(F.element_at("faces", (i * 3 + n + 1).cast("int")) * 3).cast("int") for n in range(3)]
        xyz = [F.element_at("xyz", p + n + 1).alias(f"{c}{a}") for c, p in zip("abc", at, strict=True) for n, a in enumerate("xyz")]
        return F.struct(i.alias("triangle_id"), F.try_element_at("tokens", (i + 1).cast("int")).alias("interface"), *xyz)

    rows = parts.where("size(faces) > 0")
    return rows.select(*PART, *carry, F.inline(F.transform(F.sequence(F.lit(0), (F.size("faces") / 3).cast("int") - 1), corners)))


def side_counts(parts: DataFrame) -> DataFrame:
    """``mesh_id, part_id, n_sides, n_odd``: sides of the faces of each part, and those in an odd number of faces: none if it is closed. Counted in a part's own row, many rows at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count = pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False)
            faces, ends = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.cumsum(count)
            found = np.zeros((len(count), 2), dtype=np.int64)
            for n, (to, size) in enumerate(zip(ends.tolist(), count.tolist(), strict=True)):
                u = faces[to - size : to].reshape(-1, 3)
                v = u[:, [1, 2, 0]]
                _, times = np.unique(np.minimum(u, v) << 32 | np.maximum(u, v), return_counts=True)
                found[n] = len(times), np.count_nonzero(times % 2)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found[:, 0]), pa.array(found[:, 1])], names=[*PART, "n_sides", "n_odd"])

    return parts.where("size(faces) > 0").select(*PART, "faces").mapInArrow(run, "mesh_id bigint, part_id int, n_sides bigint, n_odd bigint")


def convex_hulls(vertices: DataFrame, keys: list[str] = PART) -> DataFrame:
    """``keys, triangle_id, v0, v1, v2``: hull faces over the part's own points, wound outwards; none for flat parts."""

    def run(key: tuple, p: np.ndarray) -> pd.DataFrame:
        faces = k.fix_normals(p, k.convex_hull(p))
        out = pd.DataFrame(faces.astype(np.int32), columns=["v0", "v1", "v2"])
        out.insert(0, "triangle_id", np.arange(len(out), dtype=np.int32))
        for name, value in reversed(list(zip(keys, key, strict=True))):
            out.insert(0, name, value)
        return out

    kinds = dict(vertices.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in keys) + ", triangle_id int, v0 int, v1 int, v2 int"
    return per_points(vertices, run, schema, keys)


def components(vertices: DataFrame, triangles: DataFrame, least_volume: float = 1e-6) -> DataFrame:
    """``PARTS`` rows: the connected components of each mesh, in order of their first triangle."""
    return per_mesh(vertices, triangles, lambda key, p, f: packed(key, k.separate(k.Solid(p, f), least_volume)), PARTS)


def component_labels(vertices: DataFrame, triangles: DataFrame) -> DataFrame:
    """``mesh_id, part_id, triangle_id, root``: for each triangle the smallest that shared sides lead to."""

    def run(key: tuple, p: np.ndarray, f: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"mesh_id": key[0], "part_id": key[1], "triangle_id": np.arange(len(f), dtype=np.int32), "root": k.face_labels(f).astype(np.int32)})

    return per_mesh(vertices, triangles, run, "mesh_id bigint, part_id int, triangle_id int, root int")


def clip_meshes(vertices: DataFrame, triangles: DataFrame, planes: DataFrame, split: int = 1) -> DataFrame:
    """``PARTS`` rows: each mesh cut by its planes ``mesh_id, plane_id, a, b, c, d`` one after the other, capped; a mesh without a plane stays whole.

    Python cuts many meshes at a time (:mod:`meshlake.clipping`).
    """
    cuts = planes.groupBy("mesh_id").agg(F.array_sort(F.collect_list(F.struct("plane_id", "a", "b", "c", "d"))).alias("cuts"))
    cuts = cuts.select("mesh_id", F.flatten(F.transform("cuts", lambda c: F.array(*[c[n] for n in "abcd"]))).alias("more"))

    def lists(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
        return column.flatten().to_numpy(zero_copy_only=False).astype(kind), pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)

    def arrays(values: np.ndarray, n: np.ndarray, kind: pa.DataType) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(values, kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.cumsum(lists(batch.column(3), np.int64)[1])
            at = 0
            while at < batch.num_rows:  # as many meshes as have so many numbers of faces, one at least
                n = max(1, int(np.searchsorted(size, (size[at - 1] if at else 0) + AT_ONCE, "right")) - at)
                own = batch.slice(at, n)
                at += n
                (p, n_p), (f, n_f), (c, n_c) = lists(own.column(2), float), lists(own.column(3), np.int64), lists(own.column(4), float)
                found = clipping.multi_clip(p.reshape(-1, 3), n_p // 3, f.reshape(-1, 3), n_f // 3, c.reshape(-1, 4), n_c // 4)
                count = np.bincount(found.mesh, minlength=n)
                base = np.repeat(np.cumsum(found.n_points) - found.n_points, found.n_faces)
                yield pa.RecordBatch.from_arrays(
                    [
                        own.column(0).take(pa.array(found.mesh)), pa.array(np.arange(len(found.mesh)) - np.repeat(np.cumsum(count) - count, count), pa.int32()),
                        pa.array(np.repeat(count, count), pa.int32()), pa.array(np.zeros(len(found.mesh))), arrays(found.points.ravel(), found.n_points * 3, pa.float64()),
                        arrays((found.faces - base[:, None]).ravel(), found.n_faces * 3, pa.int32()), arrays(found.tokens, found.n_faces, pa.int64()), arrays(found.tokens[:0], found.n_faces * 0, pa.int32()),
                    ],
                    names=["mesh_id", "part_id", "n_parts", "concavity", "xyz", "faces", "tokens", "edges"],
                )

    return _flat(vertices, triangles, PART, cuts).mapInArrow(run, PARTS)


def flat_planes(vertices: DataFrame, triangles: DataFrame, min_area: float = 0.1) -> DataFrame:
    """``mesh_id, surface_id, area, n_triangles, a, b, c, d``: planes just above the large flat regions."""

    def run(key: tuple, p: np.ndarray, f: np.ndarray) -> pd.DataFrame:
        planes, regions, areas = k.flat_surfaces(p, f, min_area)
        out = pd.DataFrame(planes, columns=list("abcd"))
        out.insert(0, "n_triangles", [len(r) for r in regions])
        out.insert(0, "area", areas)
        out.insert(0, "surface_id", np.arange(len(out), dtype=np.int32))
        out.insert(0, "mesh_id", key[0])
        return out

    return per_mesh(vertices, triangles, run, "mesh_id bigint, surface_id int, area double, n_triangles int, a double, b double, c double, d double")


def split_planes(vertices: DataFrame, edges: DataFrame, most: int = 2500, seed: int = 0) -> DataFrame:
    """``mesh_id, plane_id, a, b, c, d``: bisecting planes of edges drawn at random (by seed and mesh), without near repeats."""

    def run(key: tuple, v: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        p = v.sort_values("vertex_id")[["x", "y", "z"]].to_numpy(float)
        own = e.sort_values(["i", "j"])[["i", "j"]].to_numpy(np.int64)
        out = pd.DataFrame(k.candidate_planes(p, own, np.random.default_rng([seed, int(key[0])]), most), columns=list("abcd"))
        out.insert(0, "plane_id", np.arange(len(out), dtype=np.int32))
        out.insert(0, "mesh_id", key[0])
        return out

    v = dealt(vertices.select(*MESH, "vertex_id", "x", "y", "z"), MESH).groupBy(*MESH)
    return v.cogroup(dealt(edges.select(*MESH, "i", "j"), MESH).groupBy(*MESH)).applyInPandas(run, "mesh_id bigint, plane_id int, a double, b double, c double, d double")


def welded(points: DataFrame, eps: float = 1e-4, keys: list[str] = MESH) -> DataFrame:
    """``mesh_id, point_id, target_id``: the first earlier kept point within ``eps`` on every axis, else itself."""

    def run(key: tuple, v: pd.DataFrame) -> pd.DataFrame:
        v = v.sort_values("point_id")
        ids = v["point_id"].to_numpy()
        return pd.DataFrame({"mesh_id": key[0], "point_id": ids, "target_id": ids[k.weld(v[["x", "y", "z"]].to_numpy(float), eps)]})

    return dealt(points.select(*keys, "point_id", "x", "y", "z"), keys).groupBy(*keys).applyInPandas(run, "mesh_id bigint, point_id bigint, target_id bigint")


def surface_samples(vertices: DataFrame, triangles: DataFrame, resolution: int, seed: int = 0, base: float = 1.0) -> DataFrame:
    """``mesh_id, part_id, sample_id, triangle_id, x, y, z``: points spread by area, one at least on each face."""

    def run(key: tuple, p: np.ndarray, f: np.ndarray) -> pd.DataFrame:
        s, t = k.sample_surface(p, f, resolution, np.random.default_rng([seed, int(key[0]), int(key[1])]), base)
        out = pd.DataFrame(s, columns=["x", "y", "z"])
        out.insert(0, "triangle_id", t.astype(np.int32))
        out.insert(0, "sample_id", np.arange(len(out), dtype=np.int32))
        out.insert(0, "part_id", key[1])
        out.insert(0, "mesh_id", key[0])
        return out

    return per_mesh(vertices, triangles, run, "mesh_id bigint, part_id int, sample_id int, triangle_id int, x double, y double, z double")


def hull_gap(vertices: DataFrame, triangles: DataFrame, resolution: int = 3000, seed: int = 0) -> DataFrame:
    """``mesh_id, part_id, hausdorff, rv``: distance of each part from its own hull, sampled, and the radius of their volumes' difference."""

    def run(key: tuple, p: np.ndarray, f: np.ndarray) -> pd.DataFrame:
        hull = k.convex_hull(p)
        h = k.hausdorff(p, f, p, hull, resolution, np.random.default_rng([seed, int(key[0]), int(key[1])])) if len(hull) else 0.0
        rv = k.radius_of(k.volume(p, f) - k.volume(p, hull))
        return pd.DataFrame({"mesh_id": [key[0]], "part_id": [key[1]], "hausdorff": [h if np.isfinite(h) else 0.0], "rv": [rv]})

    return per_mesh(vertices, triangles, run, "mesh_id bigint, part_id int, hausdorff double, rv double")


def remesh(vertices: DataFrame, triangles: DataFrame, scale: float = 30.0, iso: float = 0.55 / 30) -> DataFrame:
    """``PARTS`` rows, one per mesh: a closed surface ``iso`` away, from a lattice of ``scale`` units to one."""

    def run(key: tuple, p: np.ndarray, f: np.ndarray) -> pd.DataFrame:
        return packed(key, [k.Solid(*k.remesh(p, f, scale, iso))])

    return per_mesh(vertices, triangles, run, PARTS)


def level_set(vertices: DataFrame, triangles: DataFrame, scale: float, iso: float) -> DataFrame:
    """``mesh_id, n_outside, n_inside, n_band``: counts of the signed lattice around each mesh, by where points lie."""

    def run(key: tuple, p: np.ndarray, f: np.ndarray) -> pd.DataFrame:
        phi, _ = k.signed_grid(p * scale, f, iso * scale)
        return pd.DataFrame({"mesh_id": [key[0]], "n_outside": [int((phi > 0).sum())], "n_inside": [int((phi < 0).sum())], "n_band": [int((np.abs(phi) <= 1).sum())]})

    return per_mesh(vertices, triangles, run, "mesh_id bigint, n_outside bigint, n_inside bigint, n_band bigint")


def decompose(vertices: DataFrame, triangles: DataFrame, concavity: float, num_parts: int, config: Config | None = None, seed: int = 0) -> DataFrame:
    """Approximate convex decomposition of every mesh: ``PARTS`` rows, hulls or (``return_parts``) the parts themselves.

    ``vertices(mesh_id, vertex_id, x, y, z)`` and ``triangles(mesh_id, triangle_id, v0, v1, v2)``. Parameters are
    checked at once; a mesh without triangles or, under "adjacent_merge", with more components than parts fails
    the job. Levels (:mod:`meshlake.operators.levels`) run when this is called. Random numbers come from
    (seed, mesh_id, part): partitioning, order and cluster size change nothing.
    """
    config = config or Config()
    validate(concavity, num_parts, config)
    from meshlake.operators import levels

    return levels.decompose(vertices, triangles, concavity, num_parts, config, seed)


def decompose_one(points: np.ndarray, faces: np.ndarray, concavity: float, num_parts: int, config: Config | None = None, seed: int = 0):
    """The same for a single mesh in memory; no Spark job."""
    from meshlake import splitting

    config = config or Config()
    validate(concavity, num_parts, config)
    return splitting.decompose(np.asarray(points, float), np.asarray(faces, np.int64), concavity, num_parts, config, [seed, 0])


def require_meshes(vertices: DataFrame, triangles: DataFrame) -> None:
    """ValueError if a mesh has points but no triangles, or the other way round: an anti-join each way, of mesh ids only."""
    v, t = vertices.select("mesh_id").distinct(), triangles.select("mesh_id").distinct()
    if v.join(t, "mesh_id", "left_anti").limit(1).count() or t.join(v, "mesh_id", "left_anti").limit(1).count():
        raise ValueError("Each input mesh must contain triangles")


