"""Queries do the whole job: all rows, at the operators' own settings."""

import numpy as np
import pytest

from meshlake import kernels as k
from meshlake import splitting
from meshlake.config import Config
from meshlake.operators import solids
from meshlake.plans.queries import QUERIES
from meshlake.sources import fixtures as fx

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["k1_split_budget", "k4_adjacent_merge", "k7_whole_parts"])
def test_every_supplier_is_decomposed_at_default_settings(spark, monkeypatch, name):
    seen = {}

    def decompose(vertices, triangles, concavity, num_parts, config=None, seed=0):
        seen.update(v=vertices, t=triangles, config=config or Config())
        return spark.createDataFrame([], solids.PARTS)

    monkeypatch.setattr(solids, "decompose", decompose)
    QUERIES[name](spark, DATA)
    keys = {r[0] for r in spark.read.parquet(f"{DATA}/supplier.parquet").select("s_suppkey").collect()}
    for table in ("v", "t"):
        assert {r[0] for r in seen[table].select("mesh_id").distinct().collect()} == keys
    own = ("scale", "retry_scale", "retry_points", "cage_scale", "max_planes", "selection_samples", "final_samples")
    assert all(getattr(seen["config"], n) == getattr(Config(), n) for n in own)


def test_concavity_is_measured_again_after_merging(monkeypatch):
    """Both halves of an L are convex; merged back they are as far from their hull as the L is."""
    points, faces = np.array(fx.LPRISM_POINTS), np.array(fx.LPRISM_FACES)
    monkeypatch.setattr(splitting, "split", lambda begun, *_: k.clip(begun.parts[0], np.array([1.0, 0.0, 0.0, 0.0]), 1))
    apart = splitting.decompose(points, faces, 0.04, 1, Config(remesh=False, final_samples=500), [0])
    merged = splitting.decompose(points, faces, 0.04, 1, Config(remesh=False, final_samples=500, part_limit_policy="adjacent_merge"), [0])
    assert len(apart.parts) == 2 and apart.concavity < 0.05
    assert len(merged.parts) == 1 and merged.concavity > 0.4


@pytest.mark.parametrize(
    ("name", "operator", "settings"),
    [
        ("c10_final_concavity", "hull_gap", {"resolution": 10_000}), ("c11_selection_concavity", "hull_gap", {"resolution": 3000}), ("h5_hull_gap", "hull_gap", {"resolution": 3000}),
        ("i6_level_set", "level_set", {"scale": 30.0, "iso": 0.55 / 30}), ("i9_closed_surface", "remesh", {"scale": 30.0, "iso": 0.55 / 30}), ("i11_remesh", "remesh", {"scale": 30.0, "iso": 0.55 / 30}),
    ],
)
def test_settings_are_the_references(spark, monkeypatch, name, operator, settings):
    """At the reference's resolutions, and on a mesh that isn't its own hull."""
    import inspect

    seen, real = {}, getattr(solids, operator)

    def watched(*args, **more):
        own = inspect.signature(real).bind(*args, **more)
        own.apply_defaults()
        seen.update(own.arguments)
        return real(*args, **more)

    monkeypatch.setattr(solids, operator, watched)
    QUERIES[name](spark, DATA)
    assert all(seen[k] == v for k, v in settings.items())
    assert seen["vertices"].count() == len(fx.LPRISM_POINTS) * spark.read.parquet(f"{DATA}/part.parquet").count()
