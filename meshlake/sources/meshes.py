"""Meshes from and to files and arrays."""

from __future__ import annotations

import atexit
import colorsys
import contextlib
import io
import json
import struct
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERTICES = "mesh_id bigint, part_id int, vertex_id int, x double, y double, z double"
TRIANGLES = "mesh_id bigint, part_id int, triangle_id int, v0 int, v1 int, v2 int"
_settled: list[str] = []


def triplets(values, dtype) -> np.ndarray:
    """A copy as an (n, 3) array; ValueError for another shape."""
    out = np.array(values, dtype=dtype)
    if out.ndim != 2 or out.shape[1] != 3:
        raise ValueError("values must have shape (N, 3)")
    return out


def scratch(spark: SparkSession) -> str:
    """A new path below ``spark.checkpoint.dir``, the folder that driver and executors share.

    Only where they are one process may that be unset, as in tests: then it is a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='meshlake-')}"
    return f"{base.rstrip('/')}/meshlake/{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: its lineage ends there."""
    path = scratch(df.sparkSession)
    if not _settled:
        atexit.register(_drop_at_exit, df.sparkSession)
    _settled.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_settled(spark: SparkSession) -> int:
    """Delete the tables that :func:`settled` has left; call it when all results that read them have been written. The driver does when it ends."""
    n, jvm = len(_settled), spark._jvm
    while _settled:
        path = jvm.org.apache.hadoop.fs.Path(_settled.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n


def _drop_at_exit(spark: SparkSession) -> None:
    with contextlib.suppress(Exception):  # the session may be gone
        drop_settled(spark)


def planned(spark: SparkSession) -> None:
    """Session settings under which mesh tables are planned by what they hold.

    A table whose rows are made from few others (vertices of meshes, cells, samples) is estimated as large as these, and joins would
    send it whole to the driver and all executors. So only sizes seen at run time lead to that. Compiled methods beyond 8,000 bytes are never
    optimised by the JVM; long geometric steps are compiled in pieces instead.
    """
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "10m")
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")


def from_arrays(spark: SparkSession, meshes: Iterable[tuple]) -> tuple[DataFrame, DataFrame]:
    """Vertex and triangle tables of (points, faces) pairs, numbered from 0. For what already is in the driver's memory."""
    v, t = [], []
    for n, (points, faces) in enumerate(meshes):
        p, f = triplets(points, float), triplets(faces, np.int64)
        v.append(pd.DataFrame({"mesh_id": n, "part_id": 0, "vertex_id": np.arange(len(p)), "x": p[:, 0], "y": p[:, 1], "z": p[:, 2]}))
        t.append(pd.DataFrame({"mesh_id": n, "part_id": 0, "triangle_id": np.arange(len(f)), "v0": f[:, 0], "v1": f[:, 1], "v2": f[:, 2]}))
    none = [], []
    return (
        spark.createDataFrame(pd.concat(v), VERTICES) if v else spark.createDataFrame(none[0], VERTICES),
        spark.createDataFrame(pd.concat(t), TRIANGLES) if t else spark.createDataFrame(none[1], TRIANGLES),
    )


def to_arrays(vertices: DataFrame, triangles: DataFrame) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
    """By (mesh, part): points and faces in the driver's memory; for results that fit there."""
    v = {k: g for k, g in vertices.toPandas().groupby(["mesh_id", "part_id"])}
    t = {k: g for k, g in triangles.toPandas().groupby(["mesh_id", "part_id"])}
    empty = np.zeros((0, 3), dtype=np.int64)
    return {
        k: (
            g.sort_values("vertex_id")[["x", "y", "z"]].to_numpy(),
            t[k].sort_values("triangle_id")[["v0", "v1", "v2"]].to_numpy(np.int64) if k in t else empty,
        )
        for k, g in v.items()
    }


def read_obj(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Wavefront OBJ files, one mesh per file, numbered in order of their names.

    Lines are parsed by Spark: ``v x y z``; ``f a b c ...`` with 1-based (or negative) numbers,
    larger faces as fans. A file is read whole, since numbers depend on the order of its lines.
    """
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("name"), F.split("value", r"\r?\n").alias("lines"))
    # Numbers in order of names, without gathering these: sorted by range, then counted by partition.
    names = files.select("name").distinct().orderBy("name").rdd.zipWithIndex().map(lambda r: (r[0]["name"], r[1]))
    files = files.join(spark.createDataFrame(names, "name string, mesh_id bigint"), "name")

    def words(kind: str):
        return F.transform(F.filter("lines", lambda x: x.rlike(rf"^\s*{kind}\s")), lambda x: F.split(F.trim(x), r"\s+"))

    v = files.select("mesh_id", F.posexplode(words("v")).alias("vertex_id", "w"))
    v = v.select("mesh_id", F.lit(0).alias("part_id"), "vertex_id", *[F.col("w")[n + 1].cast("double").alias(a) for n, a in enumerate("xyz")])
    numbered = files.select("mesh_id", F.size(words("v")).alias("n"), F.posexplode(words("f")).alias("face", "w"))

    def corner(word):
        i = F.split(word, "/")[0].cast("int")
        return F.when(i < 0, F.col("n") + i).otherwise(i - 1)

    numbered = numbered.select("mesh_id", "face", F.transform(F.slice("w", F.lit(2), F.size("w") - 1), corner).alias("ids"))
    fans = numbered.where(F.size("ids") >= 3).select("mesh_id", "face", "ids", F.explode(F.sequence(F.lit(1), F.size("ids") - 2)).alias("k"))
    fans = fans.groupBy("mesh_id").agg(F.array_sort(F.collect_list(F.struct("face", "k", "ids"))).alias("all"))
    fans = fans.select("mesh_id", F.posexplode("all").alias("triangle_id", "t"))
    t = fans.select(
        "mesh_id", F.lit(0).alias("part_id"), "triangle_id", F.col("t.ids")[0].alias("v0"),
        F.element_at("t.ids", F.col("t.k") + 1).alias("v1"), F.element_at("t.ids", F.col("t.k") + 2).alias("v2"),
    )
    return v, t


def write_obj(vertices: DataFrame, triangles: DataFrame, path: str) -> None:
    """An OBJ text per mesh and part below ``path/mesh_id=.../part_id=...``; faces are 1-based."""
    keys = ["mesh_id", "part_id"]
    v = vertices.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("vertex_id", F.concat_ws(" ", F.lit("v"), "x", "y", "z").alias("line")))).alias("vs"))
    face = F.concat_ws(" ", F.lit("f"), *[(F.col(f"v{n}") + 1).cast("string") for n in range(3)])
    t = triangles.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("triangle_id", face.alias("line")))).alias("ts"))
    text = F.array_join(F.concat(F.transform("vs", lambda x: x["line"]), F.coalesce(F.transform("ts", lambda x: x["line"]), F.array().cast("array<string>"))), "\n")
    v.join(t, keys, "left").select(*keys, text.alias("value")).write.partitionBy(*keys).text(path)


def glb(parts: list[tuple[int, np.ndarray, np.ndarray]]) -> bytes:
    """A binary glTF scene: a node ``part_NNN`` with a colour of its own for each (part id, points, faces).

    Its last byte is padding, a zero that the format allows.
    """
    scene = {"asset": {"version": "2.0"}, "scene": 0, "scenes": [{"nodes": list(range(len(parts)))}], "nodes": [], "meshes": [], "materials": [], "accessors": [], "bufferViews": [], "buffers": []}
    data = b""
    for n, (part_id, points, faces) in enumerate(parts):
        p, f = np.ascontiguousarray(points, dtype="<f4"), np.ascontiguousarray(faces, dtype="<u4")
        for view, target in ((p, 34962), (f, 34963)):
            scene["bufferViews"].append({"buffer": 0, "byteOffset": len(data), "byteLength": view.nbytes, "target": target})
            data += view.tobytes()
        scene["accessors"].append({"bufferView": 2 * n, "componentType": 5126, "count": len(p), "type": "VEC3", "min": p.min(axis=0).tolist(), "max": p.max(axis=0).tolist()})
        scene["accessors"].append({"bufferView": 2 * n + 1, "componentType": 5125, "count": f.size, "type": "SCALAR"})
        colour = [*colorsys.hsv_to_rgb(part_id * 0.618033988749895 % 1, 0.6, 0.9), 1.0]  # steps of the golden ratio: neighbours differ
        scene["materials"].append({"pbrMetallicRoughness": {"baseColorFactor": colour, "metallicFactor": 0.0}, "doubleSided": True})
        scene["meshes"].append({"primitives": [{"attributes": {"POSITION": 2 * n}, "indices": 2 * n + 1, "material": n}]})
        scene["nodes"].append({"mesh": n, "name": f"part_{part_id:03d}"})
    scene["buffers"].append({"byteLength": len(data) + 3})
    head = json.dumps({k: v for k, v in scene.items() if v or k == "asset" or k == "scene"}, separators=(",", ":")).encode()
    head += b" " * (-len(head) % 4)
    body = data + bytes(4)
    return struct.pack("<4sII", b"glTF", 2, 28 + len(head) + len(body)) + struct.pack("<I4s", len(head), b"JSON") + head + struct.pack("<I4s", len(body), b"BIN\0") + body


def write_glb(parts: DataFrame, path: str) -> None:
    """One binary glTF file for each mesh below ``path/mesh_id=...``, of the rows that a decomposition gives (``mesh_id, part_id, xyz, faces``).

    Parts without triangles are left out. A mesh's parts meet in one row.
    """
    rows = parts.where("size(faces) > 0").groupBy("mesh_id").agg(F.array_sort(F.collect_list(F.struct("part_id", "xyz", "faces"))).alias("parts"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            files = [glb([(r["part_id"], np.reshape(r["xyz"], (-1, 3)), np.reshape(r["faces"], (-1, 3))) for r in own]) for own in batch["parts"]]
            yield pd.DataFrame({"mesh_id": batch["mesh_id"], "content": [x[:-1] for x in files]})

    # The text writer puts bytes as they are; the line end that it adds is the last byte.
    made = rows.mapInPandas(run, "mesh_id bigint, content binary").select("mesh_id", F.col("content").cast("string").alias("value"))
    made.write.partitionBy("mesh_id").option("lineSep", "\0").text(path)


def read_npz(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """NumPy archives with ``vertices`` and ``facets``; the mesh id is the number in the file's name."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    files = files.select(F.regexp_extract("path", r"([0-9]+)[^0-9/]*$", 1).cast("bigint").alias("mesh_id"), "content")

    def load(batches: Iterator[pd.DataFrame], name: str, columns: list[str], at: str) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for mesh_id, content in zip(batch["mesh_id"], batch["content"], strict=True):
                with np.load(io.BytesIO(content)) as data:
                    rows = triplets(data[name], float if name == "vertices" else np.int64)
                out = pd.DataFrame(rows, columns=columns)
                out.insert(0, at, np.arange(len(out)))
                out.insert(0, "part_id", 0)
                out.insert(0, "mesh_id", mesh_id)
                yield out

    return (
        files.mapInPandas(lambda b: load(b, "vertices", ["x", "y", "z"], "vertex_id"), VERTICES),
        files.mapInPandas(lambda b: load(b, "facets", ["v0", "v1", "v2"], "triangle_id"), TRIANGLES),
    )
