"""Approximate nearest neighbours with an inverted multi-index.

Vectors are cut in half, and each half is quantised with a codebook of its own;
a cell is a pair of centroids. A query walks the cells that hold vectors in order
of the summed distance of its halves to the two centroids, with a heap, until
they hold enough. The vectors in them are then ranked by their exact distance.

How many are enough is measured: a bounded sample of rows is held against all
rows, and the share is taken at which the walk has reached nearly all of the
sample's true neighbours. With vectors that cluster it is small; without any
structure no index can make it so.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshlake.llm.common import cut, small_batches

#: Rows that codebooks are fitted on at most; centroids per half at most, and sampled rows for each.
MAX_SAMPLE, MAX_CENTROIDS, ROWS_PER_CENTROID = 20_000, 1024, 8
#: As many numbers at most are in a block of vectors and in a pack of queries that are compared at once (a single vector may have more).
BLOCK_NUMBERS, PACK_NUMBERS = 1 << 18, 1 << 14
#: Rows whose true neighbours are looked up to choose the share, and the part of these that the walk has to reach.
PROBES, RECALL = 128, 0.935
#: Partitions at most.
MAX_TASKS = 8192


@dataclass(frozen=True)
class MultiIndex:
    """Two codebooks, and the cells that hold vectors, in order of their first centroid: bounded by the codebooks' size."""

    left: np.ndarray
    right: np.ndarray
    first: np.ndarray
    second: np.ndarray
    sizes: np.ndarray

    @staticmethod
    def _far(v: np.ndarray, book: np.ndarray) -> np.ndarray:
        return np.maximum((v * v).sum(axis=1)[:, None] - 2 * v @ book.T + (book * book).sum(axis=1), 0)

    def far(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances of each vector's halves to all centroids."""
        half = self.left.shape[1]
        return self._far(v[:, :half], self.left), self._far(v[:, half:], self.right)

    def codes(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.far(v)
        return a.argmin(axis=1), b.argmin(axis=1)

    def walk(self, a: np.ndarray, b: np.ndarray, enough: int) -> Iterator[tuple[float, int, int]]:
        """``summed distance, i, j`` of cells that hold vectors, nearest first, until they hold ``enough``.

        ``a`` and ``b`` are the distances of a query's halves. The heap holds the next cell of each first centroid; the
        cells of one are put in order when the walk gets there.
        """
        rows, starts = np.unique(self.first, return_index=True)
        ends = np.append(starts[1:], len(self.first))
        own, best = b[self.second], np.zeros(0)
        if len(rows):
            best = a[rows] + np.minimum.reduceat(own, starts)
        heap = [(float(d), int(n), -1) for n, d in enumerate(best)]
        heapq.heapify(heap)
        queues: dict[int, tuple[list[float], list[int]]] = {}
        reached = 0
        while heap and reached < enough:
            d, n, at = heapq.heappop(heap)
            if at < 0:
                part = slice(starts[n], ends[n])
                order = np.argsort(own[part], kind="stable")
                queues[n] = (a[rows[n]] + own[part][order]).tolist(), (order + starts[n]).tolist()
                at = 0
            sums, cells = queues[n]
            if at + 1 < len(cells):
                heapq.heappush(heap, (sums[at + 1], n, at + 1))
            reached += int(self.sizes[cells[at]])
            yield d, int(rows[n]), int(self.second[cells[at]])


def _codebook(v: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Lloyd's k-means from distinct rows drawn at random; in order of the direction in which they differ most, so that neighbours stand near."""
    if not v.shape[1]:
        return np.zeros((1, 0))
    rng = np.random.default_rng(seed)
    distinct = np.unique(v, axis=0)
    c = distinct[rng.permutation(len(distinct))[:k]]
    for _ in range(8):
        at = MultiIndex._far(v, c).argmin(axis=1)
        n = np.bincount(at, minlength=len(c))
        sums = np.stack([np.bincount(at, weights=column, minlength=len(c)) for column in v.T], axis=1)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    middle = c - c.mean(axis=0)
    return c[np.argsort(middle @ np.linalg.svd(middle, full_matrices=False)[2][0], kind="stable")]


def _usable(column: str) -> Column:
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return ~bad & F.exists(column, lambda x: x != 0)


def _blocks(index: MultiIndex, asks: np.ndarray, block: int, pack: int) -> tuple[list[int], list[int], list[int]]:
    """For each first centroid its first block and in how many its vectors are dealt; for each block into how many packs its queries go.

    Small neighbours share a block; one with more vectors than a block holds is split.
    """
    held = np.bincount(index.first, weights=index.sizes, minlength=len(index.left)).astype(np.int64)
    asked = np.bincount(index.first, weights=asks, minlength=len(index.left)).astype(np.int64)
    at, parts, queries, room = [], [], [], 0
    for n, q in zip(held.tolist(), asked.tolist(), strict=True):
        if n <= room:
            at.append(len(queries) - 1)
            parts.append(1)
            queries[-1] += q
            room -= n
            continue
        at.append(len(queries))
        parts.append(max(1, -(-n // block)))
        queries += [-(-q // parts[-1])] * parts[-1]
        room = block - n if parts[-1] == 1 else 0
    return at, parts, [max(1, -(-q // pack)) for q in queries]


def _reach(index: MultiIndex, probes: np.ndarray, found: list, recall: float) -> float:
    """The share of all vectors that walks have to take so that they reach ``recall`` of the neighbours ``found`` (probe, i, j)."""
    a, b = index.far(probes)
    own: dict[int, list[tuple[int, int]]] = {}
    for probe, i, j in found:
        own.setdefault(probe, []).append((i, j))
    shares: list[float] = []
    for probe, cells in own.items():
        score = a[probe][index.first] + b[probe][index.second]
        order = np.argsort(score, kind="stable")
        passed = np.cumsum(index.sizes[order])
        here = np.array([a[probe][i] + b[probe][j] for i, j in cells])
        # The walk has to go on until the last cell at this distance is in.
        shares += (passed[np.searchsorted(score[order], here, side="right") - 1] / passed[-1]).tolist()
    return float(np.quantile(shares, recall, method="higher")) if shares else 1.0


def search(
    vectors: DataFrame, queries: Column, k: int = 10, share: float | None = None, recall: float = RECALL, max_sample: int = MAX_SAMPLE,
    max_centroids: int = MAX_CENTROIDS, block_numbers: int = BLOCK_NUMBERS, pack_numbers: int = PACK_NUMBERS, probes: int = PROBES, seed: int = 11,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found of every row of ``vectors(vec_id, embedding, ...)`` that ``queries`` selects.

    The score is the Euclidean distance in double precision; ties go to the smaller vec_id.
    Rows with the query's own vec_id aren't candidates. Rows take no part whose vector is null,
    zero, holds null or non-finite components or hasn't the most frequent length among the others, or whose vec_id
    is null. Repeated vectors are candidates of their own, and repeated query rows are queries of their own:
    each has its ``k`` rows, also where they share a vec_id. No usable rows give no rows; other columns
    aren't read. Vectors may have a single component; their second half is then empty.

    A walk takes ``share`` of all vectors; if that isn't given, as many as the walks from ``probes`` rows need
    to reach ``recall`` of their true neighbours. Codebooks are fitted on at most ``max_sample`` rows. Both
    samples are chosen by a hash; all rows are indexed.
    """
    import pyarrow as pa

    spark = vectors.sparkSession
    small_batches(spark)
    names = "query_id bigint, rank int, vec_id bigint, score double"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), queries.alias("asks"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & _usable("v"))
    lengths = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).where("d > 0").orderBy(F.desc("n"), "d").limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], names)
    dims, total = lengths[0]["d"], lengths[0]["n"]
    rows = rows.where(F.size("v") == dims)
    wide = 1 << 30
    order = F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(wide))
    sample = rows.select(order.alias("order"), "vec_id", "v").where(F.col("order") < int(wide * min(1.0, max_sample / total)))
    sample = sample.orderBy("order", "vec_id", "v").limit(max_sample).toArrow()
    if not sample.num_rows:
        sample = rows.select("vec_id", "v").limit(1).toArrow()
    if not sample.num_rows:
        return spark.createDataFrame([], names)

    def matrix(column) -> np.ndarray:
        flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        return flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)

    v, half = matrix(sample["v"]), max(1, dims // 2)
    n_centroids = int(min(max_centroids, max(1, len(v) // ROWS_PER_CENTROID)))
    nothing = np.zeros(0, dtype=np.int64)
    index = MultiIndex(_codebook(v[:, :half], n_centroids, seed), _codebook(v[:, half:], n_centroids, seed + 1), nothing, nothing, nothing)
    books = spark.sparkContext.broadcast(index)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i, j = books.value.codes(matrix(batch.column(1))) if batch.num_rows else ([], [])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(i, pa.int32()), pa.array(j, pa.int32())], names=["vec_id", "v", "asks", "i", "j"])

    coded = cut(rows.mapInArrow(encode, "vec_id bigint, v array<double>, asks boolean, i int, j int").withColumn("row", F.monotonically_increasing_id()), "index")
    cells = coded.groupBy("i", "j").agg(F.count("*").alias("n"), F.count_if("asks").alias("asks")).orderBy("i", "j").toArrow()  # at most max_centroids squared rows
    asks = cells["asks"].to_numpy()
    if not asks.sum():
        return spark.createDataFrame([], names)
    index = MultiIndex(index.left, index.right, *(cells[c].to_numpy().astype(np.int64) for c in ("i", "j", "n")))
    n_vectors = int(index.sizes.sum())

    def nearest(q: np.ndarray, own: int, ids: np.ndarray, m: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest of the chosen rows of ``m``, as places and distances, ties to the smaller id."""
        chosen = chosen[ids[chosen] != own]
        far = np.sqrt(((m[chosen] - q) ** 2).sum(axis=1))
        if len(far) > k:
            near = np.flatnonzero(far <= np.partition(far, k - 1)[k - 1])
            chosen, far = chosen[near], far[near]
        best = np.lexsort((ids[chosen], far))[:k]
        return chosen[best], far[best]

    if share is None:
        asked = sample.slice(0, probes)
        probe_ids, probe_v = asked["vec_id"].to_numpy(), matrix(asked["v"])
        shared_probes = spark.sparkContext.broadcast((probe_ids, probe_v))

        def true_neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                ids, m, every = batch.column(0).to_numpy(), matrix(batch.column(1)), np.arange(batch.num_rows)
                own, q = shared_probes.value
                far = MultiIndex._far(q, m)
                far[own[:, None] == ids] = np.inf
                place = np.argpartition(far, k - 1, axis=1)[:, :k] if len(m) > k else np.tile(every, (len(q), 1))
                probe, score = np.repeat(np.arange(len(q)), place.shape[1]), np.take_along_axis(far, place, axis=1).ravel()
                place, fine = place.ravel(), np.isfinite(score)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(probe[fine], pa.int32()), pa.array(score[fine]), *(batch.column(n).take(pa.array(place[fine])) for n in (0, 2, 3))],
                    names=["probe", "score", "vec_id", "i", "j"],
                )

        near = coded.select("vec_id", "v", "i", "j").mapInArrow(true_neighbours, "probe int, score double, vec_id bigint, i int, j int")
        by_score = Window.partitionBy("probe").orderBy("score", "vec_id")
        near = near.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k)  # k rows of each probe
        share = _reach(index, probe_v, [(r["probe"], r["i"], r["j"]) for r in near.select("probe", "i", "j").collect()], recall)
    # Walks always pass a query's own rows and k others.
    copies = coded.groupBy("vec_id").agg(F.count("*").alias("n"), F.max("asks").alias("asks")).where("asks").agg(F.max("n")).first()[0]
    enough = max(copies + k, int(np.ceil(share * n_vectors)))
    first_block, parts, packs = _blocks(index, asks, max(1, block_numbers // dims), max(1, pack_numbers // dims))
    whole = spark.sparkContext.broadcast((index, np.array(first_block), np.array(parts)))

    def looked_up(numbers: list[int], at: Column) -> Column:
        return F.element_at(F.lit(numbers), at + 1)

    deal = F.pmod(F.xxhash64("row"), looked_up(parts, F.col("i")).cast("long"))
    dealt = coded.withColumn("block", (looked_up(first_block, F.col("i")) + deal).cast("int"))
    # A block and a pack are rows of bounded size. The blocks are shuffled once, whatever the number of queries.
    tasks = max(1, min(2 * len(packs), MAX_TASKS))
    blocks = dealt.repartition(tasks, "block").groupBy("block").agg(F.collect_list(F.struct("vec_id", "i", "j", "v")).alias("held"))
    blocks = blocks.select("block", *[F.col("held")[c].alias(c) for c in ("vec_id", "i", "j")], F.flatten(F.col("held")["v"]).alias("v"))
    asked = dealt.where("asks").withColumn("pack", F.pmod(F.xxhash64("row", F.lit(seed)), looked_up(packs, F.col("block")).cast("long")))
    asked = asked.repartition(max(1, min(sum(packs), MAX_TASKS)), "block", "pack").groupBy("block", "pack").agg(F.collect_list(F.struct("row", "vec_id", "v")).alias("asks"))
    asked = asked.select(F.col("asks")["row"].alias("row"), F.col("asks")["vec_id"].alias("own"), F.flatten(F.col("asks")["v"]).alias("q"))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, first_block, parts = whole.value
        for batch in batches:
            for row, own, q in zip(*batch.columns, strict=True):
                row, own, q = (x.values.to_numpy() for x in (row, own, q))
                a, b = index.far(q.reshape(-1, dims))
                limits, visitors = np.zeros(len(row)), {}
                for n in range(len(row)):
                    seen = set()
                    for d, i, _ in index.walk(a[n], b[n], enough):
                        limits[n] = d
                        seen.add(i)
                    for block in {int(first_block[i]) + p for i in seen for p in range(int(parts[i]))}:
                        visitors.setdefault(block, []).append(n)
                for block, who in visitors.items():
                    chosen = [pa.array([x], pa.list_(t)) for x, t in ((row[who], pa.int64()), (own[who], pa.int64()), (limits[who], pa.float64()), (q.reshape(-1, dims)[who].ravel(), pa.float64()))]
                    yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), *chosen], names=["block", "row", "own", "upto", "q"])

    walked = asked.mapInArrow(visit, "block int, row array<bigint>, own array<bigint>, upto array<double>, q array<double>")

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = whole.value[0]
        for batch in batches:
            for columns in zip(*batch.columns, strict=True):
                row, own, limits, q, ids, i, j, m = (x.values.to_numpy() for x in columns)
                q, m = q.reshape(-1, dims), m.reshape(-1, dims)
                a, b = index.far(q)
                out = []
                for n in range(len(row)):
                    # Cells up to where the walk ended; the margin is for sums that another batch has rounded otherwise.
                    inside = np.flatnonzero(a[n][i] + b[n][j] <= limits[n] * (1 + 1e-9) + 1e-12)
                    place, far = nearest(q[n], own[n], ids, m, inside)
                    out.append((np.full(len(place), row[n]), np.full(len(place), own[n]), ids[place], far))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["row", "query_id", "vec_id", "score"])

    pairs = walked.repartition(tasks, "block").join(blocks, "block").select("row", "own", "upto", "q", "vec_id", "i", "j", "v")
    near = pairs.mapInArrow(rank, "row bigint, query_id bigint, vec_id bigint, score double")
    order = Window.partitionBy("row").orderBy("score", "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
