"""MinHash near-duplicates by an LSH forest.

Each set of shingles has a signature of minima. A tree is one order of these minima, by which all signatures are
sorted: sets that are alike have a long common prefix there. Candidates are the neighbours in each tree
that have at least ``DEPTH`` minima in common. Where a region of a tree (signatures with a common prefix) is
crowded, its prefix grows until it isn't: neighbours then agree on more. What a crowd hides from its neighbours is
found by a second look: a set that failed against some member of a component is held against the component's hub, the
member with the most links, and so is each crowded region against one of its members.

Candidates pass an estimate from signatures, then the full sets are compared. A link inside a component
adds nothing, so candidates are confirmed in rounds, those that join two components only.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meshlake.llm.common import cut, small_batches, text_of, tidy
from meshlake.llm.components import connected_components

#: Words in a shingle, and the least similarity of linked documents, in hundredths.
WORDS, SIMILARITY = 5, 85
#: Minima of a signature, trees, minima that neighbours have in common at least, and those kept to sort by beyond.
MINIMA, TREES, DEPTH, REST = 128, 16, 5, 15
#: Neighbours on each side, and the members beyond which a region's prefix grows, by so many minima at a time.
NEIGHBOURS, CROWD, STEP = 4, 1 << 15, 3
#: A candidate is dropped if its estimated similarity is lower than asked for by this much, 4 deviations of the estimate.
MARGIN = 0.15
#: Bytes of text that are split into words at a time.
_PIECE = 1 << 22
SIGNS = ["s0", "s1", "s2", "s3"]
_SKETCH = T.StructType(
    [T.StructField(c, T.LongType()) for c in ("n", "hi", "lo")]
    + [T.StructField("regions", T.ArrayType(T.LongType())), T.StructField("rests", T.ArrayType(T.BinaryType()))]
    + [T.StructField(c, T.LongType()) for c in SIGNS]
)


@lru_cache
def _odd(words: int):
    import numpy as np

    return np.random.default_rng(words).integers(1 << 62, 1 << 63, size=words + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_hashes(text: str, words: int):
    """Sorted distinct 64-bit hashes of a text's shingles: of all its words if it has fewer than ``words``, none if it has none.

    Two shingles of different words share a hash by chance only, about 1 in 10**19.
    """
    import numpy as np
    from xxhash import xxh64_digest

    raw, parts, at = text.encode("utf-8", "surrogatepass").lower(), [], 0
    while at < len(raw):
        end = at + _PIECE
        while end < len(raw) and raw[end] not in b" \t\n\r\x0b\x0c":
            end += 1
        parts.append(np.frombuffer(b"".join(map(xxh64_digest, raw[at:end].split())), dtype=np.uint64))
        at = end
    h = parts[0] if len(parts) == 1 else np.concatenate([np.zeros(0, np.uint64), *parts])
    if not len(h):
        return h
    width, odd = min(words, len(h)), _odd(words)
    s = np.full(len(h) - width + 1, width, dtype=np.uint64) * odd[words]
    for k in range(width):
        s += h[k : len(h) - width + 1 + k] * odd[k]
    s ^= s >> np.uint64(32)
    s *= np.uint64(0x9E3779B97F4A7C15)
    s ^= s >> np.uint64(29)
    s.sort()
    return s[np.concatenate([[True], s[1:] != s[:-1]])]


class Signer:
    """Signatures of sets, and their prefixes in each tree."""

    def __init__(self, seed: int = 1):
        import numpy as np

        rng = np.random.default_rng(seed)
        self.flips = rng.integers(0, 1 << 32, size=MINIMA, dtype=np.uint32)
        self.factors = rng.integers(0, 1 << 31, size=MINIMA, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        # The first minima of the trees overlap as little as there are enough of them.
        orders, pool = [], []
        for _ in range(TREES):
            if len(pool) < DEPTH:
                pool = rng.permutation(MINIMA).tolist()
            first, pool = pool[:DEPTH], pool[DEPTH:]
            others = np.setdiff1d(np.arange(MINIMA), first)
            orders.append(np.concatenate([first, rng.permutation(others)[:REST]]))
        self.orders = np.array(orders)
        self.odd = rng.integers(0, 1 << 62, size=DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def minima(self, hashes):
        import numpy as np

        out = np.full(MINIMA, 0xFFFFFFFF, dtype=np.uint32)
        short = (hashes >> np.uint64(32)).astype(np.uint32)
        for at in range(0, len(short), 2048):
            mixed = short[at : at + 2048, None] ^ self.flips
            mixed *= self.factors
            np.minimum(out, mixed.min(axis=0), out=out)
        return out

    def sketch(self, hashes) -> tuple:
        """A row of ``_SKETCH``."""
        import numpy as np
        from xxhash import xxh3_128_digest

        hi, lo = np.frombuffer(xxh3_128_digest(hashes.tobytes()), dtype=np.int64).tolist()
        if not len(hashes):
            return 0, hi, lo, [], [], 0, 0, 0, 0
        m = self.minima(hashes)
        first = (m[self.orders[:, :DEPTH]].astype(np.uint64) + np.uint64(1)) * self.odd
        region = first.sum(axis=1, dtype=np.uint64)
        region ^= region >> np.uint64(31)
        mixed = m * np.uint32(0x85EBCA6B)
        mixed ^= mixed >> np.uint32(15)
        mixed *= np.uint32(0x9E3779B1)
        rests = (mixed[self.orders[:, DEPTH:]] >> np.uint32(24)).astype(np.uint8)
        low = (mixed >> np.uint32(30)).astype(np.uint8)  # two bits of each minimum
        bits = np.stack([low >> 1, low & 1], axis=1).ravel()
        signs = np.packbits(bits).view(np.int64).tolist()
        return len(hashes), hi, lo, region.view(np.int64).tolist(), [r.tobytes() for r in rests], *signs


def sketches(docs: DataFrame, words: int = WORDS, carry: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id``, the columns in ``carry`` and those of ``_SKETCH`` for each row: the size of its set, a 128-bit name of it, its place in each tree."""
    import pyarrow as pa

    kept = ["doc_id", *carry]
    rows = docs.select(text_of().alias("text"), *kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer()
        types = [pa.int64()] * 3 + [pa.list_(pa.int64()), pa.list_(pa.binary())] + [pa.int64()] * 4
        for batch in batches:
            made = [signer.sketch(shingle_hashes(t, words)) for t in batch.column(0).to_pylist()]
            arrays = [pa.array([m[k] for m in made], t) for k, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *arrays], names=[*kept, "n", "hi", "lo", "regions", "rests", *SIGNS])

    small_batches(docs.sparkSession)
    return rows.mapInArrow(tidy(run), T.StructType([*rows.schema.fields[1:], *_SKETCH.fields]))


def full_sets(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``hi, lo, items``: the name of each row's set and the hashes in it."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        from xxhash import xxh3_128_digest

        for batch in batches:
            own = [shingle_hashes(t, words) for t in batch.column(0).to_pylist()]
            name = np.frombuffer(b"".join(xxh3_128_digest(x.tobytes()) for x in own), dtype=np.int64)
            items = pa.array([x.view(np.int64) for x in own], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(name[::2]), pa.array(name[1::2]), items], names=["hi", "lo", "items"])

    small_batches(docs.sparkSession)
    return docs.select(text_of().alias("text")).mapInArrow(tidy(run), "hi long, lo long, items array<long>")


def _estimate(a: str, b: str) -> Column:
    """The similarity that two signatures suggest: the share of equal two-bit pieces, less what is equal by chance."""
    same = F.lit(MINIMA)
    for s in SIGNS:
        x = F.col(f"{a}.{s}").bitwiseXOR(F.col(f"{b}.{s}"))
        differ = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555))
        same = same - F.bit_count(differ)
    return (same / MINIMA - 0.25) / 0.75


def _possible(pairs: DataFrame, similarity: int) -> DataFrame:
    """``a, b, estimate`` of the pairs (structs ``x``, ``y``) whose sizes and signatures allow the similarity."""
    sizes = F.least("x.n", "y.n") * 100 >= F.greatest("x.n", "y.n") * similarity
    rows = pairs.where("x.id <> y.id").where(sizes).withColumn("estimate", _estimate("x", "y"))
    rows = rows.where(F.col("estimate") >= similarity / 100 - MARGIN)
    return rows.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"), "estimate")


def candidates(sets: DataFrame, similarity: int = SIMILARITY, crowd: int = CROWD) -> DataFrame:
    """``a, b, estimate`` (a < b): neighbours in the trees, from ``sets(id, n, regions, rests, s0 .. s3)``. No sets, no rows."""
    trees = F.transform(F.arrays_zip("regions", "rests"), lambda t, k: F.struct(F.xxhash64(k, t["regions"]).alias("region"), t["rests"].alias("rest")))
    rows = sets.select(F.struct("id", "n", *SIGNS).alias("x"), F.inline(trees))
    found, at = [], 1
    sizes = cut(rows.groupBy("region").agg(F.count("*").alias("size"), F.min("x.id").alias("first")).where("size > 1"), "regions")
    now = rows.join(sizes, "region")
    quiet = [now.where(F.col("size") <= crowd)]
    crowded = sizes.where(F.col("size") > crowd)
    while crowded.limit(1).count():
        own = cut(rows.join(crowded, "region"), "crowded")
        firsts = own.where("x.id = first").select("region", F.col("x").alias("y"))
        found.append(_possible(own.join(firsts, "region").select("x", "y"), similarity))
        if at > REST:  # all minima agree: regions of equal size, by id
            share = F.pmod(F.xxhash64("x.id"), F.ceil(F.col("size") / crowd))
            quiet.append(own.withColumn("region", F.xxhash64("region", share)))
            break
        rows = own.select("x", "rest", F.xxhash64("region", F.substring("rest", at, STEP)).alias("region"))
        sizes = cut(rows.groupBy("region").agg(F.count("*").alias("size"), F.min("x.id").alias("first")).where("size > 1"), "regions")
        quiet.append(rows.join(sizes, "region").where(F.col("size") <= crowd))
        crowded, at = sizes.where(F.col("size") > crowd), at + STEP
    placed = quiet[0].select("region", "rest", "x")
    for more in quiet[1:]:
        placed = placed.unionByName(more.select("region", "rest", "x"))
    order = Window.partitionBy("region").orderBy("rest", "x.id").rowsBetween(1, NEIGHBOURS)
    near = placed.withColumn("next", F.collect_list("x").over(order)).select("x", F.explode("next").alias("y"))
    out = _possible(near, similarity)
    for more in found:
        out = out.unionByName(more)
    return out.distinct()


def _confirmed(pairs: DataFrame, items: DataFrame, similarity: int) -> DataFrame:
    """``a, b, linked`` of ``pairs(a, b)``: whether their full sets in ``items(id, items)`` are similar enough."""
    one = pairs.join(items.select(F.col("id").alias("a"), F.col("items").alias("own")), "a")
    two = one.join(items.select(F.col("id").alias("b"), F.col("items").alias("other")), "b")
    both = F.size(F.array_intersect("own", "other"))
    union = F.size("own") + F.size("other") - both
    return two.select("a", "b", (both.cast("long") * 100 >= union.cast("long") * similarity).alias("linked"))


def _turned(pairs: DataFrame) -> DataFrame:
    return pairs.unionByName(pairs.select(*[F.col({"a": "b", "b": "a"}.get(c, c)).alias(c) for c in pairs.columns]))


def _by_hubs(tested: DataFrame, roots: DataFrame) -> DataFrame:
    """``a, b``: each set that failed against a member of another component, with the member of it that has the most links."""
    degree = _turned(tested.where("linked").select("a", "b")).groupBy("a").agg(F.count("*").alias("links")).withColumnRenamed("a", "node")
    members = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    hubs = members.join(degree, "node").groupBy("root").agg(F.max(F.struct("links", (-F.col("node")).alias("less"))).alias("hub"))
    hubs = hubs.select(F.col("root").alias("rb"), (-F.col("hub.less")).alias("hub"))
    failed = _apart(tested.where("NOT linked"), roots)
    failed = failed.select("a", "rb").unionByName(failed.select(F.col("b").alias("a"), F.col("ra").alias("rb"))).distinct()
    return failed.join(hubs, "rb").select(F.least("a", "hub").alias("a"), F.greatest("a", "hub").alias("b")).distinct()


def links(docs: DataFrame, sets: DataFrame, words: int = WORDS, similarity: int = SIMILARITY, crowd: int = CROWD) -> tuple[DataFrame, DataFrame]:
    """Confirmed links ``a, b`` between the ids of ``sets``, and the components ``node, root`` that they make (ids without links and roots aside)."""
    pairs = cut(candidates(sets, similarity, crowd), "candidates")
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    wanted = cut(sets.join(ids, "id", "left_semi").select("id", "hi", "lo", "first"), "wanted")
    texts = docs.join(wanted.select(F.col("first").alias("first_id")).distinct(), F.col("doc_id").eqNullSafe(F.col("first_id")), "left_semi")
    items = full_sets(texts, words).join(wanted.drop("first"), ["hi", "lo"]).groupBy("id").agg(F.first("items").alias("items"))
    items = cut(items, "sets")
    # First the most promising pair of each set.
    best = _turned(pairs).groupBy("a").agg(F.max(F.struct("estimate", "b")).alias("best"))
    best = best.select(F.least("a", "best.b").alias("a"), F.greatest("a", "best.b").alias("b")).distinct()
    tested = cut(_confirmed(best, items, similarity), "tested")
    roots = connected_components(tested.where("linked").select("a", "b"))
    turn = 0
    while True:
        # Then all others, then second looks until there is nothing left to look at.
        more = pairs.select("a", "b") if turn == 0 else _by_hubs(tested, roots)
        todo = cut(_apart(more.join(tested, ["a", "b"], "left_anti"), roots).select("a", "b", "ra", "rb"), "todo")
        if todo.limit(1).count():
            found = cut(_confirmed(todo.select("a", "b"), items, similarity), "found")
            fresh = todo.join(found.where("linked"), ["a", "b"]).select(F.col("ra").alias("a"), F.col("rb").alias("b"))
            if found.where("linked").limit(1).count():
                # Only components that new links join get other roots.
                moved = connected_components(fresh)
                other = moved.select(F.col("node").alias("root"), F.col("root").alias("further"))
                kept = roots.join(other, "root", "left").select("node", F.coalesce("further", "root").alias("root"))
                roots = cut(kept.unionByName(moved), "roots")
            tested = cut(tested.unionByName(found), "tested")
        elif turn:
            return tested.where("linked").select("a", "b"), roots
        turn += 1


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """``pairs(a, b, ...)`` between different components, with their roots ``ra, rb``."""
    named = pairs.join(roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a", "left")
    named = named.join(roots.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b", "left")
    named = named.withColumns({"ra": F.coalesce("ra", "a"), "rb": F.coalesce("rb", "b")})
    return named.where("ra <> rb")


def near_duplicates(docs: DataFrame, words: int = WORDS, similarity: int = SIMILARITY, carry: tuple[str, ...] = (), crowd: int = CROWD) -> DataFrame:
    """One row per row of ``docs(doc_id, text, ...)``: ``doc_id``, the columns in ``carry``, ``n_shingles, component_id, kept, root``.

    ``root`` tells components apart; it is null where the set is empty. Documents are linked whose sets of ``words``-word shingles have ``similarity`` hundredths of their union in common at
    least; fewer words make one shingle. component_id is the smallest doc_id that links reach. Null and
    empty texts, and texts of white space, have an empty set and are linked with nothing. Equal sets are handled once, however many
    documents have them. Null ids are values like others (component_id is null if no id of the component is known);
    repeated rows are in one component; an empty table gives no rows; other columns aren't read. Texts are taken whole.
    """
    made = cut(sketches(docs, words, carry), "sketches")
    named = made.where("n > 0").groupBy("hi", "lo").agg(F.min("doc_id").alias("first"), *[F.first(c).alias(c) for c in ("n", "regions", "rests", *SIGNS)])
    sets = cut(named.withColumn("id", F.monotonically_increasing_id()), "distinct")
    _, roots = links(docs.select("doc_id", "text"), sets, words, similarity, crowd)
    placed = sets.select("id", "hi", "lo", "first").join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    placed = cut(placed, "placed")
    least = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = placed.join(least, "root").select("hi", "lo", "root", "component_id")
    out = made.select("doc_id", *carry, "hi", "lo", F.col("n").alias("n_shingles")).join(classes, ["hi", "lo"], "left")
    first = F.when(F.col("root").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", *carry, "n_shingles", first.alias("component_id"), first.eqNullSafe(F.col("doc_id")).alias("kept"), "root")
