"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within radius r have a common variant within r / 2 bits of
each. So every distinct fingerprint emits all its variants within half the
radius, variants are shuffled, and those that meet on a variant are linked to
the smallest one there. All that meet on a variant are within r of each other,
and there are no more of them than variants: links to the smallest lose nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meshlake.llm.common import cut, small_batches, text_of, tidy
from meshlake.llm.components import connected_components

#: XXH64's seed, words in a shingle, and the differing bits up to which documents are linked.
SEED, WORDS, RADIUS = 42, 3, 2
_AT_ONCE = 1 << 15


def fingerprint(text: str, words: int = WORDS, seed: int = SEED) -> int:
    """The unsigned 64-bit SimHash of a text; 0 if it has no words."""
    import numpy as np
    from xxhash import xxh64_digest

    w = text.encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    if len(w) < words:
        return int.from_bytes(xxh64_digest(b" ".join(w), seed), "big")
    counts, n = np.zeros(64, dtype=np.int64), len(w) - words + 1
    for at in range(0, n, _AT_ONCE):
        part = w[at : at + _AT_ONCE + words - 1]
        grams = map(b" ".join, zip(*(part[k:] for k in range(words)), strict=False))
        raw = np.frombuffer(b"".join([xxh64_digest(g, seed) for g in grams]), dtype=np.uint8)
        counts += np.unpackbits(raw.reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = WORDS, seed: int = SEED, carry: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id``, the columns in ``carry``, and ``fp`` (signed long with the fingerprint's bits) for each row; null text is empty."""
    import numpy as np
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, words, seed) for t in batch.column(0).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(fps.view(np.int64))], names=[*kept, "fp"])

    small_batches(docs.sparkSession)
    kept = ["doc_id", *carry]
    rows = docs.select(text_of().alias("text"), *kept)
    return rows.mapInArrow(tidy(run), T.StructType([*rows.schema.fields[1:], T.StructField("fp", T.LongType())]))


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Verified links ``a, b`` (a < b) between distinct fingerprints ``fp``; together they connect all within ``radius``."""
    if radius < 0 or radius % 2:
        raise ValueError("radius must be even: all fingerprints that meet are then within it")
    masks = [0] + [sum(1 << k for k in ks) for n in range(1, radius // 2 + 1) for ks in combinations(range(64), n)]
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
    variants = distinct.select("fp", F.explode(F.array(*map(F.lit, signed))).alias("mask"))
    variants = variants.select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("variant"))
    met = variants.withColumn("least", F.min("fp").over(Window.partitionBy("variant")))
    pairs = met.where("fp <> least").select(F.col("least").alias("a"), F.col("fp").alias("b")).distinct()
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def near_duplicates(
    docs: DataFrame, radius: int = RADIUS, words: int = WORDS, seed: int = SEED, carry: tuple[str, ...] = ()
) -> DataFrame:
    """One row per row of ``docs(doc_id, text, ...)``: ``doc_id``, the columns in ``carry``, ``fp, root, component_id``.

    ``root`` is the smallest fingerprint of the row's component, and tells components apart.
    component_id is the smallest doc_id that links of at most ``radius`` differing bits
    reach, the row's own included; null only if all of them are null. Texts without words
    have fingerprint 0 and are linked like any other. Equal fingerprints are handled once,
    however many documents share them. An empty table gives no rows; other columns aren't read.
    """
    fps = cut(fingerprints(docs, words, seed, carry), "fingerprints")
    n = fps.count()
    distinct = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct", n)
    roots = connected_components(links(distinct, radius), n)
    placed = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    placed = cut(placed, "placed", n)
    first = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = cut(placed.join(first, "root").select("fp", "root", "component_id"), "classes", n)
    return fps.join(classes, "fp").select("doc_id", *carry, "fp", "root", "component_id")
