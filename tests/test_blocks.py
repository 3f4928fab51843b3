"""Nearest points and distances of parts by blocks, against brute force: clusters, copies, groups smaller than k; and what is shuffled or joined."""

import numpy as np
import pandas as pd
import pytest

from meshlake.operators import blocks
from meshlake.operators import relations as rel
from meshlake.plans.queries import QUERIES


def brute(df, k):
    out = set()
    for part, g in df.groupby("part_id"):
        p, ids = g[["x", "y", "z"]].to_numpy(), g["id"].to_numpy()
        for i, q in zip(ids, p, strict=True):
            d = (q - p) ** 2
            d2 = (d[:, 0] + d[:, 1] + d[:, 2]) * 1e9
            d2 = np.floor(d2) + (d2 - np.floor(d2) >= 0.5)
            order = [j for j in np.lexsort((ids, d2)) if ids[j] != i][:k]
            out |= {(part, i, n, ids[j]) for n, j in enumerate(order, 1)}
    return out


@pytest.mark.parametrize("size", [16, 64])
def test_the_nearest_of_all(spark, size):
    rng = np.random.default_rng(0)
    clouds = [rng.normal(size=(500, 3)), rng.normal(size=(300, 3)) * [1, 1e-3, 0], np.repeat(rng.integers(0, 3, (40, 3)).astype(float), 8, axis=0), rng.normal(size=(3, 3)), np.ones((90, 3)),
              np.concatenate([rng.normal(size=(200, 3)) * 1e-2, rng.normal(size=(20, 3)) * 50])]
    df = pd.concat([pd.DataFrame(c, columns=list("xyz")).assign(part_id=n) for n, c in enumerate(clouds)], ignore_index=True)
    df["id"] = rng.permutation(len(df))
    found = blocks.nearest_points(spark.createDataFrame(df), 7, ["part_id"], size).select("part_id", "sample_id", "rank", "target_id").collect()
    assert len(found) == len(set(found)) and {tuple(r) for r in found} == brute(df, 7)


def test_no_pairs_of_points_are_joined(spark):
    """Pairs of a point and all in the cells around it were shuffled, in round after round; now blocks answer for the points sent to them."""
    plan = QUERIES["d6_knn10"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "px#" not in plan and "qx#" not in plan


def part_cloud(rng):
    """Parts that overlap, lie far apart, in two planes, on a line, at one place in copies, and one of a lump with a point far away."""
    plane = np.concatenate([rng.random((300, 2)), np.zeros((300, 1))], axis=1)
    return [rng.normal(size=(300, 3)), rng.normal(size=(200, 3)) + 0.5, rng.normal(size=(150, 3)) + [40, 0, 0], plane - 9, plane[:200] - 9 + [0, 0.001, 1], np.linspace(0, 1, 90)[:, None] * [1.0, 0, 0],
            np.full((120, 3), 0.25), np.concatenate([rng.normal(size=(100, 3)) * 1e-7 + 3, [[1e4, 1e4, 1e4]]]), rng.normal(size=(1, 3))]


@pytest.mark.parametrize("size", [4, 32, 512])
def test_the_least_distance_of_all(spark, size):
    made = part_cloud(np.random.default_rng(1))
    df = pd.concat([pd.DataFrame(c * (m + 1), columns=list("xyz")).assign(mesh_id=m, part_id=3 * n - 2) for m in range(2) for n, c in enumerate(made)], ignore_index=True)
    found = {tuple(r)[:3]: r["distance"] for r in rel.part_distances(spark.createDataFrame(df), size=size).collect()}
    want = {}
    for m, a, b in [(m, a, b) for m in range(2) for a in range(len(made)) for b in range(a + 1, len(made))]:
        off = made[a][:, None] * (m + 1) - made[b][None] * (m + 1)
        want[m, 3 * a - 2, 3 * b - 2] = np.sqrt((off[..., 0] * off[..., 0] + off[..., 1] * off[..., 1] + off[..., 2] * off[..., 2]).min())
    assert found == want


def test_parts_without_finite_points_have_distances_too(spark):
    """As in SQL: null where all distances are null, else the least, NaN being more than infinity. Pairs with null were left out."""
    inf, nan = float("inf"), float("nan")
    rows = [(0, 1, 1.0, 0.0, 0.0), (0, 1, None, 0.0, 0.0), (0, 2, 0.0, 0.0, None), (0, 3, inf, 0.0, 0.0), (0, 4, 3.0, 0.0, 0.0), (0, 4, nan, 0.0, 0.0), (0, 5, inf, nan, 0.0), (0, 5, inf, 1.0, 1.0), (0, None, 1.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "mesh_id bigint, part_id int, x double, y double, z double")
    found = {(r["p1"], r["p2"]): repr(r["distance"]) for r in rel.part_distances(df).collect()}
    assert found == {(1, 2): "None", (1, 3): "inf", (1, 4): "2.0", (1, 5): "inf", (2, 3): "None", (2, 4): "None", (2, 5): "None", (3, 4): "inf", (3, 5): "nan", (4, 5): "inf"}
    assert rel.part_distances(df.where("false")).count() == 0


def joined(plan) -> int:
    """Rows that the joins of an executed plan gave."""
    while plan.nodeName() == "AdaptiveSparkPlan" or "QueryStage" in plan.nodeName():
        plan = plan.executedPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan.plan()
    n = plan.metrics().apply("numOutputRows").value() if "Join" in plan.nodeName() else 0
    return n + sum(joined(plan.children().apply(k)) for k in range(plan.children().size()))


def test_pairs_of_parts_join_fewer_rows_than_points(spark, monkeypatch):
    """At 8 cells to an axis the points of two near cells were joined, all with all: joins gave 3.3 million rows for these."""
    rng, written, settled = np.random.default_rng(2), [], blocks.settled
    df = pd.DataFrame(rng.random((8000, 3)), columns=list("xyz")).assign(mesh_id=0, part_id=np.arange(8000) % 2)
    monkeypatch.setattr(blocks, "settled", lambda rows: written.append(settled(rows)) or written[-1])
    found = rel.part_distances(spark.createDataFrame(df).repartition(4))
    assert len(found.collect()) == 1
    assert joined(found._jdf.queryExecution().executedPlan()) + sum(t.count() for t in written) < 8000
