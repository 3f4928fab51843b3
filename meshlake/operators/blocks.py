"""Nearest points by blocks: points that lie near each other in one row, and only what may matter sent to other blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshlake.sources.meshes import settled

#: Points of a block, and cells to an axis, at most, by which boxes of blocks meet.
BLOCK, SIDE = 512, 64
#: Nodes of a tree over blocks have this power of two children at most.
FAN = 3
_BOX = [f"{end}{a}" for end in ("lo", "hi") for a in "xyz"]


def _spread(cell: Column) -> Column:
    """The bits of a number below 2 ** 20, two zeros between each."""
    v = cell.cast("bigint")
    for shift, mask in ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249)):
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
    return v


def blocks(points: DataFrame, keys: list[str], size: int = BLOCK, per_cell: float = 8) -> DataFrame:
    """``keys, block, ids, xyz``: the points of ``points(keys, id, x, y, z)`` in rows of at most ``size``, along a curve through each group's cells.

    Blocks are cut by rank, so none is larger, however the points lie; a group may share a rank's block with another, but not the row.
    """
    from meshlake.operators.relations import _in_cells, with_rank

    cells = _in_cells(points.select(*keys, "id", *[F.col(a).cast("double").alias(a) for a in "xyz"]), per_cell, keys)
    code = sum((F.shiftleft(_spread(F.least(F.col(f"c{a}"), F.lit((1 << 20) - 1))), n) for n, a in enumerate("yz", 1)), _spread(F.least(F.col("cx"), F.lit((1 << 20) - 1))))
    ranked = with_rank(cells.select(*keys, "id", *"xyz", code.alias("code")), [*keys, "code", "id"])
    rows = ranked.groupBy(*keys, F.floor((F.col("rank") - 1) / size).alias("block")).agg(F.array_sort(F.collect_list(F.struct("id", *"xyz"))).alias("rows"))
    return rows.select(*keys, "block", F.col("rows.id").alias("ids"), F.flatten(F.transform("rows", lambda r: F.array(*[r[a] for a in "xyz"]))).alias("xyz"))


def nearest(q_ids: np.ndarray, q: np.ndarray, t_ids: np.ndarray, t: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``t`` of the ``k`` nearest to each of ``q``, and their squares, rounded to 9 digits as SQL does; inf where there are fewer. ``t_ids`` ascend: ties go to the smaller; a point isn't near itself."""
    places, squares = [], []
    for at in range(0, len(q), 128):
        off = [q[at : at + 128, None, n] - t[None, :, n] for n in range(3)]
        d2 = (off[0] * off[0] + off[1] * off[1] + off[2] * off[2]) * 1e9
        low = np.floor(d2)
        d2 = (low + (d2 - low >= 0.5)) / 1e9
        d2[q_ids[at : at + 128, None] == t_ids] = np.inf
        if k < d2.shape[1]:  # those up to the k-th square, ties with it included, then in order
            limit = np.partition(d2, k - 1, axis=1)[:, k - 1 : k]
            if (wide := int((d2 <= limit).sum(axis=1).max())) < d2.shape[1] // 2:
                first = np.sort(np.argpartition(np.where(d2 <= limit, -1.0, 1.0), wide - 1, axis=1)[:, :wide], axis=1)
                order = np.take_along_axis(first, np.argsort(np.take_along_axis(d2, first, axis=1), axis=1, kind="stable")[:, :k], axis=1)
            else:
                order = np.argsort(d2, axis=1, kind="stable")[:, :k]
        else:
            order = np.argsort(d2, axis=1, kind="stable")
        places.append(order)
        squares.append(np.take_along_axis(d2, order, axis=1))
    return np.concatenate(places), np.concatenate(squares)


def _numbers(row: pa.ListScalar) -> np.ndarray:
    return row.values.to_numpy(zero_copy_only=False)


def _points(row: pa.ListScalar) -> np.ndarray:
    return _numbers(row).reshape(-1, 3)


def _table(batch: pa.RecordBatch, keys: list[str], rows: list[int], **columns) -> pa.RecordBatch:
    own = [batch.column(k).take(pa.array(rows, pa.int64())) for k in keys]
    return pa.RecordBatch.from_arrays([*own, *columns.values()], names=[*keys, *columns])


def _found(batch: pa.RecordBatch, keys: list[str], parts: list[tuple]) -> pa.RecordBatch:
    """Rows ``keys, sample_id, target_id, d2`` of (row, samples, targets, squares)."""
    n = [len(p[1]) for p in parts]
    rows = np.repeat(np.array([p[0] for p in parts], dtype=np.int64), n)
    values = [np.concatenate([np.zeros(0, kind), *[p[c] for p in parts]]) for c, kind in ((1, np.int64), (2, np.int64), (3, float))]
    return _table(batch, keys, rows, sample_id=pa.array(values[0]), target_id=pa.array(values[1]), d2=pa.array(values[2]))


def nearest_points(points: DataFrame, k: int, keys: list[str], size: int = BLOCK) -> DataFrame:
    """``keys, sample_id, rank, target_id, d2``: the ``k`` nearest other points of each of ``points(keys, id, x, y, z)`` in its group; ties to the smaller id.

    A point first meets its own block, which tells how far its ``k``-th neighbour is at most. It is then sent to the other blocks whose boxes are nearer
    than that, and these send back what they have within that distance. So shuffles carry points, a few times each, and their candidates, not pairs.
    """
    kinds = {c: t for c, t in points.dtypes}
    if kinds["id"] != "bigint":
        raise ValueError("ids must be of type bigint")
    schema = "".join(f"{c} {kinds[c]}, " for c in keys)
    held = settled(blocks(points, keys, size))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reach, box = [], []
            for ids, xyz in zip(batch.column("ids"), batch.column("xyz"), strict=True):
                ids, p = _numbers(ids), _points(xyz)
                _, d2 = nearest(ids, p, ids, p, k)
                far = d2[:, k - 1] if d2.shape[1] >= k else np.full(len(p), np.inf)
                reach.append(far)
                wide = (np.sqrt(far) + 1e-4)[:, None]
                box.append(np.concatenate([p.min(axis=0), p.max(axis=0), (p - wide).min(axis=0), (p + wide).max(axis=0)]))
            table = np.array(box).reshape(-1, 12)
            names = [*_BOX, *[f"r{c}" for c in _BOX]]
            yield _table(batch, keys, list(range(batch.num_rows)), block=batch.column("block"), reach=pa.array(reach, pa.list_(pa.float64())), **{c: pa.array(table[:, n]) for n, c in enumerate(names)})

    boxes = settled(held.mapInArrow(first, f"{schema}block bigint, reach array<double>, " + ", ".join(f"{p}{c} double" for p in ("", "r") for c in _BOX)))

    # Boxes meet by cells, about as large as a group's boxes are on average.
    sides = [F.max(f"hi{a}") - F.min(f"lo{a}") for a in "xyz"]
    grid = boxes.groupBy(*keys).agg(
        F.greatest(*[F.avg(F.col(f"hi{a}") - F.col(f"lo{a}")) for a in "xyz"], *[s / SIDE for s in sides], F.lit(1e-12)).alias("cell"),
        *[F.min(f"lo{a}").alias(f"from{a}") for a in "xyz"], *[F.max(f"hi{a}").alias(f"to{a}") for a in "xyz"],
    )
    placed = boxes.drop("reach").join(grid, keys)

    def cells(rows: DataFrame, prefix: str) -> DataFrame:
        for a in "xyz":
            low, high = F.greatest(F.col(f"{prefix}lo{a}"), F.col(f"from{a}")), F.least(F.col(f"{prefix}hi{a}"), F.col(f"to{a}"))
            ends = [F.floor((e - F.col(f"from{a}")) / F.col("cell")) for e in (low, high)]
            rows = rows.withColumn(f"c{a}", F.explode(F.sequence(*ends)))
        return rows

    one = cells(placed, "r").select(*keys, "block", *[f"r{c}" for c in _BOX], "cx", "cy", "cz")
    two = cells(placed, "").select(*keys, F.col("block").alias("other"), *_BOX, "cx", "cy", "cz")
    meet = F.lit(True)
    for a in "xyz":
        meet = meet & (F.col(f"rlo{a}") <= F.col(f"hi{a}")) & (F.col(f"lo{a}") <= F.col(f"rhi{a}"))
    pairs = one.join(two, [*keys, "cx", "cy", "cz"]).where(meet & (F.col("block") != F.col("other"))).select(*keys, "block", "other", F.array(*_BOX).alias("box")).distinct()
    near = pairs.groupBy(*keys, "block").agg(F.collect_list("other").alias("others"), F.flatten(F.collect_list("box")).alias("boxes"))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, other, own_ids, own_xyz, own_reach = [], [], [], [], []
            for n, (ids, xyz, reach, others, ends) in enumerate(zip(*[batch.column(c) for c in ("ids", "xyz", "reach", "others", "boxes")], strict=True)):
                ids, p, far, others, ends = _numbers(ids), _points(xyz), _numbers(reach), _numbers(others), _numbers(ends).reshape(-1, 6)
                for o, e in zip(others.tolist(), ends, strict=True):
                    off = np.maximum(np.maximum(e[:3] - p, p - e[3:]), 0.0)
                    to = off[:, 0] * off[:, 0] + off[:, 1] * off[:, 1] + off[:, 2] * off[:, 2] <= far + 1e-8
                    if to.any():
                        rows.append(n)
                        other.append(o)
                        own_ids.append(ids[to])
                        own_xyz.append(p[to].ravel())
                        own_reach.append(far[to])
            lists = {c: pa.array(v, pa.list_(t)) for c, v, t in (("q_ids", own_ids, pa.int64()), ("q_xyz", own_xyz, pa.float64()), ("reach", own_reach, pa.float64()))}
            yield _table(batch, keys, rows, block=pa.array(other, pa.int64()), **lists)

    sent = held.join(boxes.select(*keys, "block", "reach"), [*keys, "block"]).join(near, [*keys, "block"]).select(*keys, "block", "ids", "xyz", "reach", "others", "boxes")
    sent = sent.mapInArrow(send, f"{schema}block bigint, q_ids array<bigint>, q_xyz array<double>, reach array<double>")

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for n, (ids, xyz, q_ids, q_xyz, reach) in enumerate(zip(*[batch.column(c) for c in ("ids", "xyz", "q_ids", "q_xyz", "reach")], strict=True)):
                ids, q_ids = _numbers(ids), _numbers(q_ids)
                places, d2 = nearest(q_ids, _points(q_xyz), ids, _points(xyz), k)
                which, at = np.nonzero((d2 <= _numbers(reach)[:, None]) & (d2 < np.inf))
                parts.append((n, q_ids[which], ids[places[which, at]], d2[which, at]))
            yield _found(batch, keys, parts)

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for n, (ids, xyz) in enumerate(zip(batch.column("ids"), batch.column("xyz"), strict=True)):
                ids, p = _numbers(ids), _points(xyz)
                places, d2 = nearest(ids, p, ids, p, k)
                which, at = np.nonzero(d2 < np.inf)
                parts.append((n, ids[which], ids[places[which, at]], d2[which, at]))
            yield _found(batch, keys, parts)

    found = f"{schema}sample_id bigint, target_id bigint, d2 double"
    elsewhere = held.join(sent, [*keys, "block"]).select(*keys, "ids", "xyz", "q_ids", "q_xyz", "reach").mapInArrow(answer, found)
    order = Window.partitionBy(*keys, "sample_id").orderBy("d2", "target_id")
    every = held.mapInArrow(own, found).unionByName(elsewhere).withColumn("rank", F.row_number().over(order))
    return every.where(F.col("rank") <= k).select(*keys, "sample_id", "rank", "target_id", "d2")


def least_squares(p_ids: np.ndarray, p: np.ndarray, q_ids: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The least square of a distance between points of two different ids, the smaller id first. Both ids ascend."""
    off = [p[:, None, n] - q[None, :, n] for n in range(3)]
    d2 = off[0] * off[0] + off[1] * off[1] + off[2] * off[2]
    (own, rows), (other, columns) = np.unique(p_ids, return_index=True), np.unique(q_ids, return_index=True)
    d2 = np.minimum.reduceat(np.minimum.reduceat(d2, rows, axis=0), columns, axis=1)
    at, to = np.nonzero(own[:, None] != other[None])
    return np.minimum(own[at], other[to]), np.maximum(own[at], other[to]), d2[at, to]


def _outside(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Squares of how far points are from the box of others."""
    off = np.maximum(np.maximum(q.min(axis=0) - p, p - q.max(axis=0)), 0.0)
    return off[:, 0] * off[:, 0] + off[:, 1] * off[:, 1] + off[:, 2] * off[:, 2]


def _squares(batch: pa.RecordBatch, keys: list[str], parts: list[tuple]) -> pa.RecordBatch:
    """Rows ``keys, p1, p2, d2`` of (row, first ids, second ids, squares)."""
    rows = np.repeat(np.array([p[0] for p in parts], dtype=np.int64), [len(p[1]) for p in parts])
    p1, p2, d2 = (np.concatenate([np.zeros(0, kind), *[p[c] for p in parts]]) for c, kind in ((1, np.int64), (2, np.int64), (3, float)))
    return _table(batch, keys, rows, p1=pa.array(p1), p2=pa.array(p2), d2=pa.array(d2))


def part_squares(points: DataFrame, keys: list[str], size: int = BLOCK) -> DataFrame:
    """``keys, p1, p2, d2`` (p1 < p2): the least square of a distance between points of two parts of ``points(keys, id, x, y, z)``; ``id`` is a point's part.

    All parts of a group share its blocks, so points of two parts that lie near each other mostly meet within one, which tells how near the parts are
    at least. Each part's boxes in the blocks are the leaves of a tree along the curve, and pairs of parts descend their trees together: of two
    nodes only children that may be nearer than what is known already are held against each other. The blocks of the leaves that are left meet.
    """
    kinds = {c: t for c, t in points.dtypes}
    if kinds["id"] != "bigint":
        raise ValueError("ids must be of type bigint")
    schema = "".join(f"{c} {kinds[c]}, " for c in keys)
    held = settled(blocks(points.distinct(), keys, size, 2.0**-60))  # the finest cells, so that a point far away doesn't make one of all others

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, box = [], []
            for n, (ids, xyz) in enumerate(zip(batch.column("ids"), batch.column("xyz"), strict=True)):
                ids, p = _numbers(ids), _points(xyz)
                own, starts = np.unique(ids, return_index=True)
                ends = np.concatenate([np.minimum.reduceat(p, starts), np.maximum.reduceat(p, starts)], axis=1)
                p1, p2, d2 = least_squares(ids, p, ids, p)
                once = np.unique(np.stack([p1, p2]), axis=1, return_index=True)[1]  # each pair came twice
                parts.append((n, np.concatenate([own, p1[once]]), np.concatenate([own, p2[once]]), np.concatenate([np.zeros(len(own)), d2[once]])))
                box += [*ends, *[None] * len(once)]
            found = _squares(batch, keys, parts)
            block = batch.column("block").take(pa.array(np.repeat(np.arange(len(parts)), [len(p[1]) for p in parts])))
            yield found.append_column("block", block).append_column("box", pa.array(box, pa.list_(pa.float64())))

    seen = settled(held.mapInArrow(first, f"{schema}p1 bigint, p2 bigint, d2 double, block bigint, box array<double>"))
    within = seen.where("p1 <> p2").groupBy(*keys, "p1", "p2").agg(F.min("d2").alias("d2"))

    # Blocks are counted from each group's first.
    starts = held.groupBy(*keys).agg(F.min("block").alias("start"), F.max("block").alias("end"))
    leaves = seen.where("p1 = p2").join(starts, keys).select(*keys, F.col("p1").alias("part"), (F.col("block") - F.col("start")).alias("node"), *[F.col("box")[n].alias(c) for n, c in enumerate(_BOX)])
    depth = -(-int(starts.agg(F.coalesce(F.max(F.col("end") - F.col("start")), F.lit(0))).first()[0]).bit_length() // FAN)

    def nodes(level: int, k: int) -> DataFrame:
        node = F.shiftright("node", FAN * level).alias(f"n{k}")
        ends = [(F.min if c.startswith("lo") else F.max)(c).alias(f"{c}{k}") for c in _BOX]
        return leaves.groupBy(*keys, F.col("part").alias(f"p{k}"), node).agg(*ends).withColumn(f"up{k}", F.shiftright(f"n{k}", FAN))

    def square(steps: list[Column]) -> Column:
        return steps[0] * steps[0] + steps[1] * steps[1] + steps[2] * steps[2]

    gaps = [F.greatest(F.col(f"lo{a}1") - F.col(f"hi{a}2"), F.col(f"lo{a}2") - F.col(f"hi{a}1"), F.lit(0.0)) for a in "xyz"]
    spans = [F.greatest(F.col(f"hi{a}1") - F.col(f"lo{a}2"), F.col(f"hi{a}2") - F.col(f"lo{a}1")) for a in "xyz"]
    pair = [*keys, "p1", "p2"]

    def bounded(met: DataFrame, measured: DataFrame) -> DataFrame:
        """Those of ``met`` that may hold nearer points than ``measured``, and no farther ones than the bounds of others."""
        known = met.groupBy(*pair).agg(F.min("most").alias("bound")).join(measured, pair, "left")
        return met.join(known, pair).where("least <= bound AND (d2 IS NULL OR least < d2)").withColumn("bound", F.least("bound", "d2"))

    roots = nodes(depth, 1), nodes(depth, 2)
    met = roots[0].join(roots[1], keys).where("p1 < p2").select(*pair, "n1", "n2", square(gaps).alias("least"), square(spans).alias("most"))
    for level in reversed(range(depth)):
        above = bounded(met, within).select(*pair, F.col("n1").alias("up1"), F.col("n2").alias("up2"))
        below = above.join(nodes(level, 1), [*keys, "p1", "up1"]).join(nodes(level, 2), [*keys, "p2", "up2"])
        below = below.select(*pair, "n1", "n2", square(gaps).alias("least"), square(spans).alias("most"))
        met = settled(below.join(within, pair, "left").where("d2 IS NULL OR least < d2").drop("d2"))

    def measured(near: DataFrame) -> DataFrame:
        """Squares of all pairs of parts in pairs of blocks ``near(keys, n1, n2, bound)``."""
        two = near.where("n1 <> n2").groupBy(*keys, F.least("n1", "n2").alias("n1"), F.greatest("n1", "n2").alias("n2")).agg(F.max("bound").alias("reach"))
        numbered = held.join(starts, keys)
        for k in (1, 2):
            two = two.join(numbered.select(*keys, (F.col("block") - F.col("start")).alias(f"n{k}"), F.col("ids").alias(f"ids{k}"), F.col("xyz").alias(f"xyz{k}")), [*keys, f"n{k}"])

        def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                parts = []
                for n, (reach, p_ids, p, q_ids, q) in enumerate(zip(*[batch.column(c) for c in ("reach", "ids1", "xyz1", "ids2", "xyz2")], strict=True)):
                    reach, p_ids, p, q_ids, q = reach.as_py(), _numbers(p_ids), _points(p), _numbers(q_ids), _points(q)
                    to = _outside(p, q) <= reach
                    p_ids, p = p_ids[to], p[to]
                    to = _outside(q, p) <= reach if len(p) else np.zeros(len(q), bool)
                    if to.any():
                        parts.append((n, *least_squares(p_ids, p, q_ids[to], q[to])))
                yield _squares(batch, keys, parts)

        rows = two.select(*keys, "reach", "ids1", "xyz1", "ids2", "xyz2").mapInArrow(answer, f"{schema}p1 bigint, p2 bigint, d2 double")
        return rows.groupBy(*pair).agg(F.min("d2").alias("d2"))

    # Parts that share no block: the most promising two blocks first, so that the others are held against a distance of points.
    apart = met.join(within, pair, "left_anti").groupBy(*pair).agg(F.min_by(F.struct("n1", "n2", F.col("most").alias("bound")), "most").alias("best"))
    started = settled(measured(apart.select(*keys, "best.*")))
    known = within.unionByName(started).groupBy(*pair).agg(F.min("d2").alias("d2"))
    return known.unionByName(measured(bounded(met, known))).groupBy(*pair).agg(F.min("d2").alias("d2"))
