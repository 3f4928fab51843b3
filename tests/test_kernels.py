"""Kernels against known shapes and properties."""

import numpy as np
import pytest

from meshlake import kernels as k
from meshlake.config import Config, validate
from meshlake.operators.solids import decompose_one
from meshlake.sources import fixtures as fx

L, LF = np.array(fx.LPRISM_POINTS), np.array(fx.LPRISM_FACES)
BOX, BF = np.array(fx.BOX_POINTS), np.array(fx.BOX_FACES)
SMALL = {"scale": 6, "cage_scale": 16, "max_planes": 200, "selection_samples": 10, "final_samples": 10}


def test_known_measures():
    assert k.volume(L, LF) == pytest.approx(3.0)
    assert k.face_areas(L, LF).sum() == pytest.approx(14.0)
    assert k.is_closed(LF)
    hull = k.convex_hull(L)
    assert k.volume(L, hull) == pytest.approx(3.5)
    assert 0.3 * k.radius_of(0.5) == pytest.approx(0.147712, abs=1e-6)


@pytest.mark.parametrize("seed", range(8))
def test_hull_is_closed_and_holds_all_points(seed):
    rng = np.random.default_rng(seed)
    p = rng.normal(size=(int(rng.integers(4, 400)), 3)) * rng.uniform(0.1, 10, 3)
    f = k.convex_hull(p)
    assert k.is_closed(f)
    n = k.face_normals(p, f)
    assert (p @ n.T - np.einsum("ij,ij->i", n, p[f[:, 0]])).max() < 1e-8 * np.abs(p).max()
    assert (k.fix_normals(p, f) == f).all()


def test_flat_points_have_no_hull():
    assert not len(k.convex_hull(np.zeros((5, 3))))
    assert not len(k.convex_hull(np.array([[0, 0, 0], [1, 0, 0], [0, 1, 0], [1, 1, 0.0]])))


def test_visibility_of_the_prism():
    edges = k.visible_pairs(k.Solid(L, LF), np.array(fx.CAGE_POINTS), LF)
    assert edges.tolist() == [[2, 4], [2, 10], [4, 8], [8, 10]]
    new = k.Solid(L, LF, is_new=np.arange(12) >= 10)
    assert k.visible_pairs(new, np.array(fx.CAGE_POINTS), LF).tolist() == [[2, 10], [8, 10]]
    assert not len(k.visible_pairs(k.Solid(BOX, BF), BOX * 1.1 - 0.05, BF))


@pytest.mark.parametrize("seed", range(12))
def test_clip_keeps_volume_and_closes_both_sides(seed):
    rng = np.random.default_rng(seed)
    n = rng.normal(size=3)
    n /= np.linalg.norm(n)
    parts = k.clip(k.Solid(L, LF), np.append(n, -n @ rng.uniform(0.2, 0.9, 3)), 1)
    assert len(parts) == 2
    assert sum(k.volume(p.points, p.faces) for p in parts) == pytest.approx(3.0)
    assert all(k.is_closed(p.faces) for p in parts)
    tokens = [set(p.tokens.tolist()) - {0} for p in parts]
    assert tokens[0] == {-t for t in tokens[1]} and min(tokens[0]) > 1 << 32


def test_clip_with_a_hole_in_the_cap():
    outer, inner = BOX * 4, BOX * 2 + 1
    p = np.concatenate([outer, inner])
    f = np.concatenate([BF, BF[:, [0, 2, 1]] + 8])
    parts = k.clip(k.Solid(p, f), np.array([1.0, 0, 0, -2.0]))
    assert [round(k.volume(x.points, x.faces), 6) for x in parts] == [28.0, 28.0]
    assert all(k.is_closed(x.faces) for x in parts)


def test_a_plane_that_misses_leaves_the_part():
    assert len(k.clip(k.Solid(L, LF), np.array([1.0, 0, 0, -9.0]))) == 1
    assert len(k.clip(k.Solid(L, LF), np.array([1.0, 0, 0, -2.0]))) == 1


def test_components_and_their_edges():
    p, f = np.concatenate([L, BOX + 5]), np.concatenate([LF, BF + 12])
    parts = k.separate(k.Solid(p, f, edges=np.array([[2, 4], [2, 13], [12, 13]])))
    assert [len(x.points) for x in parts] == [12, 8]
    assert [len(x.edges) for x in parts] == [1, 1]
    assert not k.separate(k.Solid(L * 1e-3, LF))


def test_nearest_agrees_with_brute_force():
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=(500, 3)), rng.normal(size=(700, 3)) * [1, 0.1, 3]
    ids, far = k.nearest(a, b)
    d = np.linalg.norm(a[:, None] - b[None], axis=2)
    assert (ids == np.argsort(d, axis=1, kind="stable")[:, :10]).all()
    assert np.allclose(far, np.sort(d, axis=1)[:, :10])


def test_remesh_is_closed_and_near():
    p, f = k.remesh(L / 2 - 0.5, LF, 10, 0.1)
    assert k.is_closed(f) and k.volume(p, f) > 0.375
    assert k.one_sided(p, *k.sample_surface(L / 2 - 0.5, LF, 2000, np.random.default_rng(0)), L / 2 - 0.5, LF) < 0.1 + 1 / 10


def test_flat_surfaces_of_a_box():
    planes, regions, areas = k.flat_surfaces(BOX * 2 - 1, BF)
    assert len(planes) == 6 and np.allclose(areas, 4) and all(len(r) == 2 for r in regions)
    assert np.allclose(np.sort(planes[:, 3]), -1.02)


def test_candidate_planes_have_no_near_repeats():
    rng = np.random.default_rng(1)
    p = rng.normal(size=(40, 3))
    edges = np.stack(np.triu_indices(40, 1), axis=1)
    planes = k.candidate_planes(p, edges, rng, 100)
    assert len(planes) <= 100 and np.allclose(np.linalg.norm(planes[:, :3], axis=1), 1)
    near = (np.abs(planes[:, :3] @ planes[:, :3].T) > np.cos(np.radians(5))) & (np.abs(planes[:, 3:] - planes[:, 3]) < 1e-3)
    assert near.sum() == len(planes)


def test_decomposition_splits_the_prism_and_repeats():
    one = decompose_one(L, LF, 0.04, 2, Config(**SMALL), seed=5)
    two = decompose_one(L, LF, 0.04, 2, Config(**SMALL), seed=5)
    assert len(one.parts) == 2 and one.concavity == two.concavity
    assert all((a[0] == b[0]).all() for a, b in zip(one.parts, two.parts, strict=True))
    assert len(decompose_one(L, LF, 10.0, 2, Config(**SMALL)).parts) == 1
    assert len(decompose_one(L, LF, 0.04, 4, Config(score_mode="none", **SMALL)).parts) == 1


@pytest.mark.parametrize("mode", ["edge", "concavity"])
def test_strict_limit(mode):
    found = decompose_one(L, LF, 0.01, 2, Config(part_limit_policy="adjacent_merge", score_mode=mode, **SMALL))
    assert len(found.parts) <= 2


def test_strict_limit_rejects_too_many_components():
    p, f = np.concatenate([BOX, BOX + 4]), np.concatenate([BF, BF + 8])
    with pytest.raises(ValueError, match="initial disconnected component count 2 exceeds num_parts 1"):
        decompose_one(p, f, 0.1, 1, Config(part_limit_policy="adjacent_merge", **SMALL))


@pytest.mark.parametrize(
    ("args", "word"),
    [
        ((0.1, 0, Config()), "num_parts"), ((float("nan"), 1, Config()), "concavity"), ((0.1, 1, Config(max_batch_size=-1)), "max_batch_size"),
        ((0.1, 1, Config(batch_cpu_threads=-1)), "batch_cpu_threads"), ((0.1, 1, Config(part_limit_policy="invalid")), "part_limit_policy"),
        ((0.1, 1, Config(batch_memory_fraction=0.0)), "batch_memory_fraction"), ((0.1, 1, Config(batch_memory_fraction=1.1)), "batch_memory_fraction"),
    ],
)
def test_validation(args, word):
    with pytest.raises(ValueError, match=word):
        validate(*args)


def test_empty_mesh_is_an_error():
    with pytest.raises(ValueError, match="triangles"):
        decompose_one(np.zeros((0, 3)), np.zeros((0, 3), int), 0.1, 1)


def test_few_samples_are_measured_in_full(monkeypatch):
    """A mesh and its hull share most of their surface: samples there need no search, and the distance is the one of all samples."""
    points = L * [6.0, 1.0, 2.0] / 6
    hull, rows = k.convex_hull(points), []
    s, t = k.sample_surface(points, LF, 3000, np.random.default_rng(0))
    u, v = k.sample_surface(points, hull, 3000, np.random.default_rng(1))
    for a, b, faces, of in ((s, u, hull, v), (u, s, LF, t)):
        some = np.random.default_rng(2).choice(len(a), 300, replace=False)
        each = [float(np.min(k.to_triangles(np.repeat(a[n : n + 1], 10, 0), *(points[faces[of[k.nearest(a[n : n + 1], b)[0][0]], c]] for c in range(3))))) for n in some]
        known = k.Balls.nearest
        monkeypatch.setattr(k.Balls, "nearest", lambda self, q, *x: (rows.append(len(q)), known(self, q, *x))[1])
        assert k.one_sided(a, b, of, points, faces) >= max(each)
        monkeypatch.undo()
    assert sum(rows) < 0.01 * (len(s) + len(u)), (rows, len(s), len(u))


def test_large_triangles_are_measured_by_planes(monkeypatch):
    """On the lattice around a mesh of large triangles no point is measured on its own, and distances are the same."""
    points, rows = L * [15.0, 25.0, 17.0] + [0.137, 0.271, 0.419], []
    known = k.to_triangles
    monkeypatch.setattr(k, "to_triangles", lambda p, *x: (rows.append(len(p)), known(p, *x))[1])
    grid, low = k.distance_grid(points, LF, 1.6)
    assert sum(rows) < 2000
    monkeypatch.setattr(k, "BOX", 1 << 40)
    one, at = k.distance_grid(points, LF, 1.6)
    assert (at == low).all() and (np.isfinite(one) == np.isfinite(grid)).all() and np.isfinite(one).sum() > 10_000
    near = np.isfinite(one)
    assert np.abs(one[near] - grid[near]).max() < 1e-9
