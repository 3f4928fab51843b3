"""Exact deduplication by deterministic block naming.

A text is cut into blocks of fixed size. Equal blocks get one integer name:
distinct blocks are dealt by hash, sorted within each partition and numbered.
Adjacent names are then paired and the pairs named in the same way, until each
document has a single name. Two documents of as many blocks have the same name
if and only if their texts are identical: names come from comparing texts, not
from a hash that could collide.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshlake.llm.common import SPACE, cut, text_of

BLOCK_CHARS = 4096


def normalised(column: str = "text"):
    """Text with each run of white space replaced by one space; null is empty."""
    return F.regexp_replace(text_of(column), f"[{SPACE}]+", " ")


def _blocks(docs: DataFrame, block_chars: int, carry: tuple[str, ...]) -> DataFrame:
    """A row for each block. An empty text has one empty block."""
    kept = F.struct("doc_id", *[F.col(c).alias(f"carry_{k}") for k, c in enumerate(carry)]).alias("row")
    rows = docs.select(kept, F.monotonically_increasing_id().alias("uid"), normalised().alias("norm"))
    rows = rows.select(
        "row",
        "uid",
        F.sha2("norm", 256).alias("sha"),
        F.regexp_extract_all("norm", F.lit(f"(?s).{{1,{block_chars}}}"), F.lit(0)).alias("blocks"),
    )
    return rows.select(
        "row",
        "uid",
        "sha",
        F.greatest(F.size("blocks"), F.lit(1)).alias("n_blocks"),
        F.posexplode_outer("blocks").alias("pos", "block"),
    ).withColumns({"pos": F.coalesce("pos", F.lit(0)), "block": F.coalesce("block", F.lit(""))})


def _numbered(distinct: DataFrame, *keys: str) -> DataFrame:
    """Integer names in sorted order within each hash partition: the same rows give the same names when a task runs again."""
    return distinct.sortWithinPartitions(*keys).withColumn("name", F.monotonically_increasing_id())


def document_names(docs: DataFrame, block_chars: int = BLOCK_CHARS, carry: tuple[str, ...] = ()) -> tuple[DataFrame, int]:
    """Rows ``uid, row, sha, n_blocks, name``, and a bound on their number; ``(n_blocks, name)`` identifies the normalised text.

    ``row`` is a struct of doc_id and, as ``carry_0`` and so on, the columns in ``carry``.

    The texts are shuffled once, to compare distinct blocks. Names go back to
    documents by the blocks' SHA-256; that it is unique among the distinct
    blocks is verified, and the job fails if it isn't.
    """
    blocks = _blocks(docs, block_chars, carry)
    key = F.unhex(F.sha2("block", 256)).alias("key")
    cells = cut(
        blocks.select("uid", "n_blocks", "pos", key, *[F.when(F.col("pos") == 0, F.col(c)).alias(c) for c in ("row", "sha")]),
        "cells",
    )
    named = _numbered(blocks.select("block").distinct(), "block").select("name", key)
    named = named.groupBy("key").agg(F.min("name").alias("name"), F.count("*").alias("n"))
    named = named.select(
        "key",
        F.when(F.col("n") == 1, F.col("name")).otherwise(
            F.raise_error(F.lit("two different blocks have the same SHA-256")).cast("long")
        ).alias("name"),
    )
    size = cells.agg(F.count("*"), F.coalesce(F.max("n_blocks"), F.lit(1)), F.count_if(F.col("n_blocks") > 1)).first()
    level = cut(cells.select("uid", "n_blocks", "pos", "key").join(named, "key").drop("key"), "names", size[0])
    done = level.where("n_blocks = 1").select("uid", "name")
    level = level.where("n_blocks > 1").select("uid", "pos", "name")
    width = size[1]
    while width > 1:
        pairs = cut(
            level.groupBy("uid", F.expr("pos div 2").cast("int").alias("pos")).agg(
                F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("left"),
                F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("right"),
            ),
            "pairs",
            size[2],
        )
        named = _numbered(pairs.select("left", "right").distinct(), "left", "right")
        level = pairs.join(named, ["left", "right"]).select("uid", "pos", "name")
        width = (width + 1) // 2
    names = done.unionByName(level.select("uid", "name"))
    return cells.where("pos = 0").select("uid", "row", "sha", "n_blocks").join(names, "uid"), size[0]


def exact_dedup(docs: DataFrame, block_chars: int = BLOCK_CHARS, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs(doc_id, text, ...)``: ``doc_id, keep_id, group_size, kept, text_sha256``, and the columns in ``carry``.

    Texts are equal when identical after each run of white space has become
    one space; null is empty. Of equal texts the row with the smallest doc_id
    stays. Of rows that repeat both doc_id and text just one is kept, by the columns in ``carry``. A null
    doc_id comes after all others; if a group has no other, keep_id is null.
    An empty table gives no rows. Other columns are neither read nor returned.
    """
    names, n = document_names(docs, block_chars, carry)
    names = cut(names, "identities", n)
    first = F.min(F.struct(F.col("row.doc_id").isNull().alias("missing"), "row", "uid")).alias("first")
    # A table of its own: the join then deals both sides anew, so that Spark can split a large group of copies.
    groups = cut(names.groupBy("n_blocks", "name").agg(first, F.count("*").alias("group_size")), "groups", n)
    return names.join(groups, ["n_blocks", "name"]).select(
        F.col("row.doc_id").alias("doc_id"),
        F.col("first.row.doc_id").alias("keep_id"),
        "group_size",
        (F.col("uid") == F.col("first.uid")).alias("kept"),
        F.col("sha").alias("text_sha256"),
        *[F.col(f"row.carry_{k}").alias(c) for k, c in enumerate(carry)],
    )
