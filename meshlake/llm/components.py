"""Connected components of a graph held as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshlake.llm.common import cut


def connected_components(edges: DataFrame, rows: int | None = None, max_rounds: int = 60) -> DataFrame:
    """``edges(a, b)`` to ``node, root``: for each node but the roots, the smallest node of its component.

    Alternating large-star and small-star steps; each round's edges are a table in the
    shared folder. Minima per node are partial aggregates, joined back: no node's
    neighbours are gathered in one place. Self-loops and repeated edges do no harm;
    null ends are dropped; no edges give no rows. ``rows`` bounds the number of edges, if known.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, before = cut(now, "edges", rows), None
    for _ in range(max_rounds):
        mark = tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
        if mark == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before, n = mark, mark[0]
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = cut(large, "large", 2 * n)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = cut(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "edges", 2 * n)
    raise RuntimeError(f"components didn't settle in {max_rounds} rounds")
