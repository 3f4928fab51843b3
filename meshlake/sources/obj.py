"""Wavefront OBJ files as a Spark data source, for reading and writing: a file for each mesh.

    register(spark)
    spark.read.format("obj").option("table", "vertices").load("shared/objs")
    spark.read.format("obj").option("table", "meshes").load("shared/objs")      # a row for each file
    rows.write.format("obj").mode("append").save("shared/objs")     # mesh_id, points, faces

Files are reached through pyarrow's file systems, so a path may be local to all machines (a shared folder) or a
URI that pyarrow knows. A folder's ``.obj`` files are numbered in order of their names.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import Row, StructType

TABLES = {
    "vertices": "mesh_id bigint, part_id int, vertex_id int, x double, y double, z double",
    "triangles": "mesh_id bigint, part_id int, triangle_id int, v0 int, v1 int, v2 int",
    "meshes": "mesh_id bigint, part_id int, points array<double>, faces array<int>",
}
#: What is written: flat arrays of coordinates and of corners, numbered from 0.
MESHES = "mesh_id bigint, points array<double>, faces array<int>"
#: Bytes of files in a partition, each file counting for so many at least.
PARTITION_BYTES, FILE_BYTES = 32 << 20, 1 << 14
#: Files whose rows a task passes on together.
AT_ONCE = 256


def _opened(path: str):
    """File system and path in it."""
    from pyarrow import fs

    if path.startswith("file:/"):
        path = "file:///" + path[len("file:") :].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def parse(text: str) -> tuple[list[tuple[float, float, float]], list[tuple[int, int, int]]]:
    """Points and triangles of one file: lines ``v x y z`` and ``f a b c ...``, numbers from 1 or, negative, from the last point; larger faces as fans."""
    points, faces = [], []
    for line in text.splitlines():
        words = line.split()
        if not words:
            continue
        if words[0] == "v":
            points.append(tuple(map(float, words[1:4])))
        elif words[0] == "f":
            own = [int(w.split("/")[0]) for w in words[1:]]
            own = [i - 1 if i > 0 else len(points) + i for i in own]
            faces += [(own[0], own[k], own[k + 1]) for k in range(1, len(own) - 1)]
    return points, faces


def render(points, faces) -> str:
    """A file of flat coordinates and corners; numbers are written so that reading gives the same doubles."""
    v = [f"v {points[k]!r} {points[k + 1]!r} {points[k + 2]!r}" for k in range(0, len(points), 3)]
    f = [f"f {faces[k] + 1} {faces[k + 1] + 1} {faces[k + 2] + 1}" for k in range(0, len(faces), 3)]
    return "\n".join([*v, *f, ""])


class ObjDataSource(DataSource):
    """``table``: "vertices", "triangles" or "meshes", what is read."""

    @classmethod
    def name(cls) -> str:
        return "obj"

    def schema(self) -> str:
        table = self.options.get("table", "vertices")
        if table not in TABLES:
            raise ValueError(f"table must be one of {', '.join(TABLES)}")
        return TABLES[table]

    def reader(self, schema: StructType) -> ObjReader:
        return ObjReader(self.options["path"], self.options.get("table", "vertices"))

    def writer(self, schema: StructType, overwrite: bool) -> ObjWriter:
        if [f.name for f in schema.fields] != [c.split()[0] for c in MESHES.split(", ")]:
            raise ValueError(f"rows to write must be {MESHES}")
        return ObjWriter(self.options["path"], overwrite)


@dataclass
class Files(InputPartition):
    """Files with the numbers of their meshes."""

    names: list[tuple[int, str]]


class ObjReader(DataSourceReader):
    def __init__(self, path: str, table: str):
        self.path, self.table = path, table

    def partitions(self) -> list[Files]:
        """Files in order of their names, dealt by size; only names and sizes come to the driver."""
        from pyarrow import fs

        files, root = _opened(self.path)
        found = sorted((f.path, f.size) for f in files.get_file_info(fs.FileSelector(root, recursive=True)) if f.is_file and f.path.endswith(".obj"))
        out, held = [Files([])], 0
        for n, (name, size) in enumerate(found):
            size = max(size or 0, FILE_BYTES)
            if out[-1].names and held + size > PARTITION_BYTES:
                out.append(Files([]))
                held = 0
            out[-1].names.append((n, name))
            held += size
        return out

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        files, _ = _opened(self.path)
        for at in range(0, len(partition.names), AT_ONCE):
            own = partition.names[at : at + AT_ONCE]
            found = []
            for _, name in own:
                with files.open_input_stream(name) as stream:
                    found.append(parse(stream.read().decode()))
            yield self._batch(np.array([n for n, _ in own], dtype=np.int64), [p for p, _ in found], [f for _, f in found])

    def _batch(self, mesh_id: np.ndarray, points: list[list], faces: list[list]) -> pa.RecordBatch:
        xyz = np.array([x for own in points for p in own for x in p], dtype=float)
        if len(xyz) != 3 * sum(map(len, points)):
            raise ValueError("a point needs three numbers")
        xyz = xyz.reshape(-1, 3)
        ids = np.array([x for own in faces for f in own for x in f], dtype=np.int32).reshape(-1, 3)
        ends = [np.cumsum([0, *map(len, own)]) for own in (points, faces)]
        if self.table == "meshes":
            lists = [pa.ListArray.from_arrays(pa.array(e * 3, pa.int32()), pa.array(v.ravel())) for e, v in zip(ends, (xyz, ids), strict=True)]
            columns = [mesh_id, np.zeros(len(mesh_id), np.int32), *lists]
        else:
            rows, end = (xyz, ends[0]) if self.table == "vertices" else (ids, ends[1])
            n = np.diff(end)
            columns = [np.repeat(mesh_id, n), np.zeros(len(rows), np.int32), (np.arange(len(rows)) - np.repeat(end[:-1], n)).astype(np.int32), *[np.ascontiguousarray(c) for c in rows.T]]
        return pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], names=[c.split()[0] for c in TABLES[self.table].split(", ")])


@dataclass
class Written(WriterCommitMessage):
    """The names of the files of a task."""

    names: list[str]


class ObjWriter(DataSourceWriter):
    """Tasks write below a folder of the job's own; the files get their places only when all tasks have succeeded."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path, overwrite, f"_temporary-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[Row]) -> Written:
        files, root = _opened(self.path)
        own = posixpath.join(root, self.job, uuid.uuid4().hex)  # of this attempt alone
        files.create_dir(own, recursive=True)
        names = []
        for row in iterator:
            if row.mesh_id is None:
                raise ValueError("a mesh without an id can't be written: its file has no name")
            name = f"mesh-{row.mesh_id:020d}.obj"
            with files.open_output_stream(posixpath.join(own, name)) as stream:
                stream.write(render(row.points or [], row.faces or []).encode())
            names.append(posixpath.join(posixpath.basename(own), name))
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        files, root = _opened(self.path)
        if self.overwrite:
            for f in files.get_file_info(fs.FileSelector(root)):
                if f.is_file and f.path.endswith(".obj"):
                    files.delete_file(f.path)
        for message in messages:
            for name in message.names if message else []:
                files.move(posixpath.join(root, self.job, name), posixpath.join(root, posixpath.basename(name)))
        self._tidy(files, root)

    def abort(self, messages: list[Written | None]) -> None:
        self._tidy(*_opened(self.path))

    def _tidy(self, files, root: str) -> None:
        from pyarrow import fs

        place = posixpath.join(root, self.job)
        if files.get_file_info(place).type == fs.FileType.Directory:
            files.delete_dir(place)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ObjDataSource)


def gathered(vertices, triangles):
    """The rows to write, of mesh tables: one row a mesh, its points and triangles in order. A mesh without triangles has points alone."""
    from pyspark.sql import functions as F

    v = vertices.groupBy("mesh_id").agg(F.array_sort(F.collect_list(F.struct("vertex_id", "x", "y", "z"))).alias("v"))
    t = triangles.groupBy("mesh_id").agg(F.array_sort(F.collect_list(F.struct("triangle_id", "v0", "v1", "v2"))).alias("t"))
    points = F.flatten(F.transform("v", lambda p: F.array(p["x"], p["y"], p["z"])))
    faces = F.flatten(F.transform("t", lambda f: F.array(*[f[f"v{k}"].cast("int") for k in range(3)])))
    return v.join(t, "mesh_id", "left").select("mesh_id", points.alias("points"), F.coalesce(faces, F.array().cast("array<int>")).alias("faces"))
