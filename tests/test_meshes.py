"""Mesh files and arrays, and the DataFrame form of the decomposition."""

import numpy as np
import pytest

from meshlake.config import Config
from meshlake.operators import solids
from meshlake.sources import fixtures as fx
from meshlake.sources import meshes

L, LF = np.array(fx.LPRISM_POINTS), np.array(fx.LPRISM_FACES)
SMALL = {"scale": 6, "cage_scale": 16, "max_planes": 200, "selection_samples": 10, "final_samples": 10}


def test_shape_is_checked(spark):
    with pytest.raises(ValueError, match="shape"):
        meshes.from_arrays(spark, [(np.zeros((3, 2)), LF)])


def test_arrays_round_trip(spark):
    back = meshes.to_arrays(*meshes.from_arrays(spark, [(L, LF), (L + 1, LF)]))
    assert (back[1, 0][0] == L + 1).all() and (back[0, 0][1] == LF).all()


def test_obj_round_trip(spark, tmp_path):
    (tmp_path / "a.obj").write_text("# a square\nv 0 0 0\nv 1 0 0\nv 1 1 0\nv 0 1 0\nf 1/1 2/2 3/3 4/4\nf -4 -2 -1\n")
    v, t = meshes.read_obj(spark, str(tmp_path / "a.obj"))
    assert v.count() == 4
    assert [tuple(r) for r in t.orderBy("triangle_id").select("v0", "v1", "v2").collect()] == [(0, 1, 2), (0, 2, 3), (0, 2, 3)]
    out = str(tmp_path / "out")
    meshes.write_obj(*meshes.from_arrays(spark, [(L, LF)]), out)
    v, t = meshes.read_obj(spark, out + "/*/*/part-*")
    assert v.count() == 12 and t.count() == 20


def test_npz(spark, tmp_path):
    np.savez(tmp_path / "17.npz", vertices=L, facets=LF)
    v, t = meshes.read_npz(spark, str(tmp_path / "17.npz"))
    assert v.count() == 12 and {r[0] for r in t.select("mesh_id").distinct().collect()} == {17}


def test_batch_keeps_meshes_apart(spark):
    v, t = meshes.from_arrays(spark, [(L + [-100, 0, 0], LF), (L + [100, 0, 0], LF)])
    parts = solids.decompose(v, t, 0.04, 2, Config(**SMALL)).orderBy("mesh_id", "part_id").collect()
    assert [(r["mesh_id"], r["part_id"], r["n_parts"]) for r in parts] == [(0, 0, 2), (0, 1, 2), (1, 0, 2), (1, 1, 2)]
    assert max(parts[0]["xyz"][::3]) < 0 < min(parts[-1]["xyz"][::3])


def test_empty_batch_and_bad_parameters(spark):
    v, t = meshes.from_arrays(spark, [])
    assert solids.decompose(v, t, 0.1, 1).count() == 0
    with pytest.raises(ValueError, match="num_parts"):
        solids.decompose(v, t, 0.1, 0)


def test_a_mesh_without_triangles(spark):
    v, t = meshes.from_arrays(spark, [(L, LF)])
    with pytest.raises(ValueError, match="triangles"):
        solids.require_meshes(v, t.where("false"))
