"""Searches by cells, ranks, bands and files against plain versions."""

import json
import struct
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshlake import kernels as k
from meshlake import splitting
from meshlake.config import Config, release_gpu_resources
from meshlake.operators import aggregates as agg
from meshlake.operators import lattice, solids
from meshlake.operators import relations as rel
from meshlake.sources import fixtures as fx
from meshlake.sources import meshes

POINTS, FACES = np.array(fx.LPRISM_POINTS), np.array(fx.LPRISM_FACES)
CLOUD = "mesh_id bigint, part_id int, vertex_id bigint, x double, y double, z double"


def cloud(spark, groups):
    """Points of several parts: scattered, in a lump with one far away, on a line, all at one place."""
    rng = np.random.default_rng(3)
    made = [rng.normal(size=(150, 3)), np.concatenate([rng.normal(size=(40, 3)) / 100, [[9.0, 9.0, 9.0]]]) + 4, np.linspace(0, 1, 30)[:, None] * [1.0, 0, 0] - 6, np.full((12, 3), 8.0)]
    rows = [(m, p, 1000 * p + n, *map(float, x)) for m in range(groups) for p, own in enumerate(made) for n, x in enumerate(own * (m + 1))]
    return spark.createDataFrame(rows, CLOUD), made


def test_nearest_points_by_cells(spark):
    df, made = cloud(spark, 2)
    for per_cell in (1, 8, 1000):
        found = rel.nearest_points(df, 5, per_cell=per_cell).collect()
        for m, (p, own) in product(range(2), enumerate(made)):
            d2 = np.round((((own * (m + 1))[:, None] - (own * (m + 1))[None]) ** 2).sum(axis=2), 9)
            for n in range(len(own)):
                truth = sorted((d2[n, o], 1000 * p + o) for o in range(len(own)) if o != n)[:5]
                got = sorted((r["rank"], r["target_id"]) for r in found if (r["mesh_id"], r["part_id"], r["sample_id"]) == (m, p, 1000 * p + n))
                assert [r for r, _ in got] == [1, 2, 3, 4, 5]
                assert sorted(round(float(d2[n, t % 1000]), 7) for _, t in got) == sorted(round(float(d), 7) for d, _ in truth)
    alone = spark.createDataFrame([(0, 0, 1, 1.0, 1.0, 1.0), (1, 0, 1, 0.0, 0.0, 0.0), (1, 0, 2, 1.0, 0.0, 0.0)], CLOUD)
    assert [tuple(r) for r in rel.nearest_points(alone, 3).orderBy("sample_id").collect()] == [(1, 0, 1, 1, 2, 1.0), (1, 0, 2, 1, 1, 1.0)]
    assert rel.nearest_points(alone.where("false"), 3).count() == 0


def test_part_distances_by_cells(spark):
    df, made = cloud(spark, 2)
    found = {(r["mesh_id"], r["p1"], r["p2"]): r["distance"] for r in rel.part_distances(df).collect()}
    assert len(found) == 12
    for (m, a, b), d in found.items():
        truth = np.linalg.norm((made[a][:, None] - made[b][None]) * (m + 1), axis=2).min()
        assert d == pytest.approx(truth, abs=1e-12)


def test_visibility_by_cells_equals_all_pairs(spark):
    p, f = k.remesh((POINTS - [1, 1, 0.5]) / 1.0, FACES, 4.0, 0.55 / 4)
    c, cf = k.remesh((POINTS - [1, 1, 0.5]) / 1.0, FACES, 4.0, 1.4 / 4)
    (v, t), (vc, tc) = meshes.from_arrays(spark, [(p, f)]), meshes.from_arrays(spark, [(c, cf)])
    found = rel.visibility_edges(v, agg.corners(t, v).drop("part_id"), agg.corners(tc, vc).drop("part_id")).collect()
    truth = k.visible_pairs(k.Solid(p, f), c, cf)
    assert {(r["i"], r["j"]) for r in found} == set(map(tuple, truth.tolist())) and len(truth) > 50


def test_hausdorff_by_bounds_equals_all(spark):
    """The search that leaves groups out against one that measures every query."""
    rng = np.random.default_rng(0)
    for scale in ((25, 3, 4), (1, 2, 1), (3, 1, 9)):
        p = POINTS * np.array(scale, float)
        p = (p - p.mean(axis=0)) / np.abs(p).max()
        hull = k.convex_hull(p)
        s, t = k.sample_surface(p, FACES, 2000, rng)
        q, u = k.sample_surface(p, hull, 2000, rng)
        for a, b, bt, faces in ((s, q, u, hull), (q, s, t, FACES)):
            ids, far = k.nearest(a, b, 10)
            corners = faces[bt[ids]]
            each = k.to_triangles(np.broadcast_to(a[:, None], (*ids.shape, 3)), p[corners[..., 0]], p[corners[..., 1]], p[corners[..., 2]]).min(axis=1)
            assert k.one_sided(a, b, bt, p, faces) == pytest.approx(float(each.max()), abs=1e-12)
            assert k.one_sided(a, b, bt, p, faces, least=99.0) == 99.0


def test_quantiles_and_ranks(spark):
    for values in ([3.0, 1.0, 2.0], [5.0], [1.0] * 7 + [2.0], list(range(101))):
        df = spark.createDataFrame([(float(x),) for x in values], "v double")
        found = {r["at"]: r["value"] for r in rel.quantiles(df, "v", [0.0, 0.1, 0.25, 0.5, 0.75, 1.0]).collect()}
        assert found == {q: pytest.approx(float(np.quantile(values, q))) for q in found} and len(found) == 6
    for n in (0, 3, 20, 23):
        rows = spark.createDataFrame([(x * 7 % 31,) for x in range(n)], "v int")
        chosen = [r["stratum"] for r in rel.choose_rows(rows, 5, 12, ["v"], F.lit(0)).collect()]
        bins = [len(x) for x in np.array_split(np.arange(n), 5)]
        assert sorted(chosen) == [b + 1 for b in range(5) for _ in range(min(bins[b], 3 if b < 2 else 2))]


def test_band_grows_to_its_width(spark):
    """One triangle: every lattice point a whole unit inside the band is found, with its distance and the side's sign."""
    v, t = meshes.from_arrays(spark, [(np.array([[0.2, 0.3, 0.1], [6.1, 0.4, 0.2], [0.3, 5.2, 0.3]]), np.array([[0, 1, 2]]))])
    corner_rows = agg.corners(t, v).drop("part_id")
    band = rel.voxelize(corner_rows, 1.0).select("mesh_id", "x", "y", "z", (F.sqrt("d2") * F.when(F.col("z") < 0, -1).otherwise(1)).alias("phi"), "triangle_id")
    found = {(r["x"], r["y"], r["z"]): r["phi"] for r in lattice.expanded(band, corner_rows, 4.0, 3.0).collect()}
    old = {(r["x"], r["y"], r["z"]) for r in band.collect()}
    a, b, c = np.array([[0.2, 0.3, 0.1], [6.1, 0.4, 0.2], [0.3, 5.2, 0.3]], dtype=np.float32).astype(float)
    for place in product(range(-6, 13), range(-6, 12), range(-6, 7)):
        far = float(k.to_triangles(np.array(place, float), a, b, c))
        if place in found and place not in old:
            assert abs(found[place]) == pytest.approx(far, abs=1e-5) and abs(found[place]) < (3 if found[place] < 0 else 4)
        elif far < 1.99:
            assert place in found
    assert len(found) > 2 * len(old)
    assert lattice.expanded(band.where("false"), corner_rows, 4.0, 3.0).count() == 0


def test_glb_files(spark):
    parts = [(0, POINTS, FACES), (7, POINTS + 5, FACES[:3])]
    whole = meshes.glb(parts)
    path = meshes.scratch(spark)
    rows = [(m, n, 2, 0.0, p.ravel().tolist(), f.ravel().tolist(), [], []) for m in (3, 4) for n, p, f in parts] + [(4, 9, 3, 0.0, [], [], [], [])]
    meshes.write_glb(spark.createDataFrame(rows, solids.PARTS), path)
    files = [bytes(r["content"]) for r in spark.read.format("binaryFile").load(f"{path}/*/*.txt").collect()]
    assert files == [whole, whole]
    magic, version, length = struct.unpack("<4sII", whole[:12])
    n, kind = struct.unpack("<I4s", whole[12:20])
    scene, body = json.loads(whole[20 : 20 + n]), whole[28 + n :]
    assert (magic, version, length, kind) == (b"glTF", 2, len(whole), b"JSON") and len(whole) % 4 == 0
    assert len(body) >= scene["buffers"][0]["byteLength"] >= len(body) - 3
    assert [x["name"] for x in scene["nodes"]] == ["part_000", "part_007"]
    assert scene["materials"][0] != scene["materials"][1]
    for (_, p, f), mesh in zip(parts, scene["meshes"], strict=True):
        one = mesh["primitives"][0]
        for at, kind, truth in ((one["attributes"]["POSITION"], "<f4", p), (one["indices"], "<u4", f)):
            view = scene["bufferViews"][scene["accessors"][at]["bufferView"]]
            raw = body[view["byteOffset"] : view["byteOffset"] + view["byteLength"]]
            assert np.allclose(np.frombuffer(raw, kind).reshape(-1, 3), truth)


def test_settings_that_only_schedule_change_nothing():
    """Every combination of threads and batch sizes gives the same digest."""
    digests = set()
    for threads, size, share, retain in product((0, 1, 3), (0, 1, 2), (0.3, 0.7), (True, False)):
        config = Config(scale=6.0, cage_scale=10.0, max_planes=50, selection_samples=50, final_samples=50, batch_cpu_threads=threads, max_batch_size=size, batch_memory_fraction=share, retain_gpu_resources=retain)
        found = splitting.decompose(POINTS, FACES, 0.04, 2, config, [1])
        digests.add((found.concavity, *[(p.tobytes(), f.tobytes()) for p, f in found.parts]))
        release_gpu_resources()
    assert len(digests) == 1


def test_forced_merge_over_infinite_costs(monkeypatch):
    """If no adjacent pair has a finite cost, the first adjacent one is merged."""
    cut = [x for own in k.clip(k.Solid(POINTS, FACES), np.array([1.0, 0, 0, -1.5]), 1) for x in k.clip(own, np.array([1.0, 0, 0, -0.5]), 2)]
    assert len(cut) == 3
    monkeypatch.setattr(splitting, "merge_cost", lambda *a: (float("inf"), 0.0))
    parts, _ = splitting.merge(cut, [0.0] * 3, 0.04, 0.0, 2, Config(part_limit_policy="adjacent_merge"), np.random.default_rng(0))
    assert len(parts) == 2 and sum(abs(k.volume(p.points, p.faces)) for p in parts) == pytest.approx(3.0)
