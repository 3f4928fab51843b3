"""What tables of many meshes need: rows dealt before they become many, joins planned by real sizes, and whole results all the same."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshlake import kernels
from meshlake.plans.queries import QUERIES
from meshlake.sources import fixtures as fx

DATA = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_meshes_are_dealt_before_their_rows_become_many(spark):
    assert fx.vertices(spark, DATA, "lprism").rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism
    assert fx.triangles(spark, DATA, "beam").rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("name", ["e2_best_plane", "h4_hausdorff", "k3_merge_costs", "c10_final_concavity", "f2_separate"])
def test_estimates_send_no_table_to_the_driver(spark, name):
    assert "BroadcastHashJoin" not in plan(QUERIES[name](spark, DATA))


def test_near_lattice_is_the_same_in_slabs():
    rng = np.random.default_rng(3)
    corners = np.concatenate([rng.normal(0, 4, (40, 9)), np.round(rng.normal(0, 3, (20, 9))), np.tile(rng.normal(0, 3, (5, 3)), 3)])

    def found(chunk):
        return sorted((t, *p, d) for own, place, d2 in kernels.near_lattice(corners, chunk) for t, p, d in zip(own.tolist(), place.tolist(), d2.tolist(), strict=True))

    whole = found(1 << 22)
    assert whole == found(64) and len(whole) > 1000
    for t in (0, 45, 62):  # by definition, point by point
        a, b, c = corners[t].reshape(3, 3)
        low, high = np.floor(np.min([a, b, c], axis=0)).astype(int), np.ceil(np.max([a, b, c], axis=0)).astype(int)
        box = np.stack(np.meshgrid(*[np.arange(lo, hi + 1) for lo, hi in zip(low, high, strict=True)], indexing="ij"), axis=-1).reshape(-1, 3)
        w = rng.dirichlet(np.ones(3), 4000)
        near = {tuple(p) for p in box if np.min(((w @ np.array([a, b, c]) - p) ** 2).sum(axis=1)) <= 0.7} | {tuple(np.floor(a).astype(int))}
        around = {(p[0] + i, p[1] + j, p[2] + k) for p in near for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)}
        assert around <= {r[1:4] for r in whole if r[0] == t}


@pytest.mark.parametrize("name", ["i3_crossing_signs", "i4_validated", "i4_cleaned", "i8_renormalized"])
def test_messages_are_hashed_not_sorted(spark, name):
    assert "SortAggregate" not in plan(QUERIES[name](spark, DATA))


def test_triangle_distances_make_no_sums_over_a_last_axis_of_three(monkeypatch):
    """Such sums were most of the time of remeshing and of samples' distances."""
    rng, seen = np.random.default_rng(0), []
    p, a, b, c = rng.normal(size=(4, 200, 3))
    want = np.min([np.linalg.norm(p - (w[:, :1] * a + w[:, 1:2] * b + w[:, 2:] * c), axis=1) for w in np.repeat(rng.dirichlet(np.ones(3), 2000)[:, None], 200, axis=1)], axis=0)
    for name in ("norm", "cross"):
        monkeypatch.setattr(np.linalg if name == "norm" else np, name, lambda *x, name=name, **y: seen.append(name))
    found = kernels.to_triangles(p, a, b, c)
    assert not seen and (found <= want + 1e-9).all() and (want - found).max() < 0.2


def test_draws_are_not_sorted(spark):
    """3,000 draws a mesh are dealt out once, and meet their triangles by hash."""
    text = plan(QUERIES["h1_surface_samples"](spark, DATA))
    made = text[text.index("ShuffledHashJoin") :]
    made = made[: made.index("Generate explode")]
    assert made.count("Exchange") <= 1 and "Sort " not in made and "Window" not in made


def test_tasks_grow_with_the_rows(spark, monkeypatch):
    """Of a fixed number of tasks, each one's memory grew with the table."""
    from meshlake.operators import aggregates

    monkeypatch.setattr(aggregates, "ROWS", 100)
    n = -(-spark.read.parquet(f"{DATA}/lineitem.parquet").count() // 100)
    text = plan(QUERIES["a14_stage_ulp"](spark, DATA))
    dealt = [line for line in text.splitlines() if "Exchange hashpartitioning" in line]
    assert n > 50 and dealt and all(f", {n}), REPARTITION_BY_NUM" in line for line in dealt)


def test_pairs_of_small_meshes_are_not_dealt_out(spark, monkeypatch):
    """Visibility of meshes of few points is tested where they lie; large ones beside them meet triangles by cells, and both give the same rows."""
    from meshlake.operators import aggregates as agg
    from meshlake.operators import relations as rel
    from meshlake.plans import queries as q
    from meshlake.sources import fixtures as fx

    d = "/root/testdata/sf0.001"
    v, own, cage = fx.vertices(spark, d, "lprism"), q._corners(spark, d, "lprism"), q._corners(spark, d, "cage")
    found = rel.visibility_edges(v, own, cage)
    assert "kx" not in found._jdf.queryExecution().optimizedPlan().toString()
    fresh = v.withColumn("is_new", (agg.F.col("vertex_id") % 5 == 0) | (agg.F.col("mesh_id") % 3 == 0))
    small = found.collect(), rel.visibility_edges(fresh, own, cage, only_new=True).collect()
    # Points that no other triangle has make one mesh a large one.
    more = v.where("mesh_id = 7 AND vertex_id = 0").select("mesh_id", "part_id", agg.F.explode(agg.F.sequence(agg.F.lit(100), agg.F.lit(170))).alias("vertex_id"), *[agg.F.lit(1e6).alias(a) for a in "xyz"])
    mixed = [r for r in rel.visibility_edges(v.unionByName(more), own, cage).collect() if r["j"] < 100]
    monkeypatch.setattr(rel, "FEW", 0)
    by_cells = rel.visibility_edges(v, own, cage).collect(), rel.visibility_edges(fresh, own, cage, only_new=True).collect()
    assert len(small[0]) > 500 and 0 < len(small[1]) < len(small[0])
    assert [sorted(x) for x in small] == [sorted(x) for x in by_cells] and sorted(mixed) == sorted(small[0])


@pytest.mark.parametrize("name", ["i9_closed_surface", "i11_remesh"])
def test_remeshed_triangles_are_not_dealt_out(spark, name):
    """What is asked of remeshed surfaces is found in a part's own row: no row for each triangle or side is dealt out, joined or gathered again."""
    tree = QUERIES[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString().split("MapInPandas")[0]
    assert "collect_list(struct(triangle_id" not in tree and tree.count("Generate") == (name == "i11_remesh")
