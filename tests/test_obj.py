"""The OBJ data source: round trips, partitions, failed tasks."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshlake.plans.queries import QUERIES
from meshlake.sources import fixtures as fx
from meshlake.sources import meshes, obj

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module", autouse=True)
def _registered(spark):
    obj.register(spark)


def read(spark, path, table):
    return spark.read.format("obj").option("table", table).load(str(path))


def test_a_file_for_each_part(spark, tmp_path, monkeypatch):
    v, t = fx.vertices(spark, DATA, "lprism"), fx.triangles(spark, DATA, "lprism")
    rows = obj.gathered(v, t).withColumn("points", F.transform("points", lambda x: x / 3))
    rows.repartition(6).write.format("obj").mode("append").save(str(tmp_path))
    assert len(os.listdir(tmp_path)) == spark.read.parquet(f"{DATA}/part.parquet").count()
    found = read(spark, tmp_path, "vertices")
    names = {n: r["mesh_id"] for n, r in enumerate(rows.select("mesh_id").orderBy("mesh_id").collect())}
    want = {r["mesh_id"]: r["points"] for r in rows.collect()}
    got = {}
    for r in found.orderBy("mesh_id", "vertex_id").collect():
        got.setdefault(names[r["mesh_id"]], []).extend([r["x"], r["y"], r["z"]])
    assert got == want  # to the last bit
    assert read(spark, tmp_path, "triangles").count() == t.count()
    monkeypatch.setattr(obj, "FILE_BYTES", obj.PARTITION_BYTES // 10)
    parts = obj.ObjReader(str(tmp_path), "vertices").partitions()
    assert len(parts) == 20 and [n for p in parts for n, _ in p.names] == list(range(200))


def test_overwrite_and_append(spark, tmp_path):
    one, two = (obj.gathered(*meshes.from_arrays(spark, [(np.eye(3) * k, [[0, 1, 2]])] * k)) for k in (2, 3))
    two.write.format("obj").mode("append").save(str(tmp_path))
    one.withColumn("mesh_id", F.col("mesh_id") + 10).write.format("obj").mode("append").save(str(tmp_path))
    assert len(os.listdir(tmp_path)) == 5
    one.write.format("obj").mode("overwrite").save(f"file://{tmp_path}")
    assert len(os.listdir(tmp_path)) == 2 and read(spark, f"file://{tmp_path}", "vertices").agg(F.max("x")).first()[0] == 2.0


def test_a_failed_task_leaves_no_files(spark, tmp_path):
    rows = spark.range(8).select(F.when(F.col("id") < 7, F.col("id")).alias("mesh_id"), F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0)).alias("points"), F.array().cast("array<int>").alias("faces"))
    with pytest.raises(Exception, match="without an id"):
        rows.repartition(4).write.format("obj").mode("append").save(str(tmp_path))
    assert [f for _, _, names in os.walk(tmp_path) for f in names] == []


def test_forms_of_lines(spark, tmp_path):
    (tmp_path / "b.obj").write_text("# comment\nv 0 0 0\nv 1 0 0 1.0\r\nv 1 1 0\nv 0 1 0\n\nvn 0 0 1\nf 1//1 2//1 3//1 4//1\nf -4 -3 -2\n")
    (tmp_path / "a.obj").write_text("")
    (tmp_path / "c.txt").write_text("v 1 2 3\n")
    t = [tuple(r) for r in read(spark, tmp_path, "triangles").orderBy("triangle_id").collect()]
    assert t == [(1, 0, 0, 0, 1, 2), (1, 0, 1, 0, 2, 3), (1, 0, 2, 0, 1, 2)]
    assert read(spark, tmp_path, "vertices").count() == 4
    with pytest.raises(Exception, match="table"):
        read(spark, tmp_path, "other").count()
    with pytest.raises(Exception, match="rows to write"):
        spark.range(1).write.format("obj").mode("append").save(str(tmp_path))


def test_meshes_are_read_once(spark, tmp_path):
    """A row for each file, as they are written; a7 read every file three times."""
    one = [(np.eye(3) * k / 3, [[0, 1, 2]] * k) for k in range(1, 4)] + [(np.eye(3), np.zeros((0, 3)))]
    rows = obj.gathered(*meshes.from_arrays(spark, one))
    rows.write.format("obj").mode("append").save(str(tmp_path))
    found = [tuple(r) for r in read(spark, tmp_path, "meshes").orderBy("mesh_id").collect()]
    assert found == [(r["mesh_id"], 0, r["points"], r["faces"]) for r in rows.orderBy("mesh_id").collect()]
    plan = QUERIES["a7_obj_source"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BatchScan") == 1
