"""Mixing sources to target weights with Sainte-Laguë apportionment.

The mix is cut into blocks of as many words each. Blocks are seats: sources get
them by the highest quotients target / (2k - 1), then the shards of a source
get the source's seats in the same way, by their words. Within a shard,
documents stand in seeded order; their words, end to end, form the shard's
blocks, and the quota takes blocks from a seeded start, going round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshlake.llm.common import SPACE, cut, text_of

WEIGHTS = (5.0, 2.0, 1.0)
#: The mix as a share of all words, and how often a document may be taken at most.
SHARE, REPEATS = 1.5, 2
#: About as many words are in a shard.
SHARD_WORDS = 1 << 20


def word_count(column: str = "text") -> Column:
    return F.regexp_count(text_of(column), F.lit(f"[^{SPACE}]+")).cast("long")


def source_targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """Adds ``weight`` and ``target`` to ``source, source_size``: one row per source, so these windows are small.

    Sources by code point, null last, weigh ``weights``, repeating. No target is above
    ``repeats`` times its source; what is above is shared by weight among the others,
    which ends at one level L with target = min(cap, weight * L).
    """
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    rank = F.row_number().over(ordered) - 1
    rows = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights)).cast("int") + 1))
    rows = rows.withColumn("cap", F.col("source_size").cast("double") * repeats)
    everything = Window.partitionBy()
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0.0)
    rows = rows.withColumn("total", F.sum("source_size").over(everything) * F.lit(share))
    rows = rows.withColumn(
        "level",
        (F.col("total") - F.coalesce(F.sum("cap").over(before), zero))
        / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), zero)),
    )
    rows = rows.withColumn("at", F.row_number().over(by_ratio))
    free = F.min(F.when(F.col("cap") >= F.col("weight") * F.col("level"), F.struct("at", "level"))).over(everything)
    return rows.withColumn(
        "target", F.least("cap", F.coalesce(F.col("weight") * free["level"], F.col("cap")))
    ).select("source", "source_size", "weight", "target")


def sainte_lague(rows: DataFrame, key: str, votes: str, seats: str, within: list[str]) -> DataFrame:
    """Adds ``quota`` (long): the seats of each row by highest quotients, ties to the smaller key.

    ``seats`` is constant within a group of ``within``. Quotients that surely win are
    counted in closed form: with n rows and V votes, those of at least V / (2 seats - n)
    are at most ``seats``, and those of at least V / (2 seats + n) are no fewer. Only
    the few per row in between are ranked, however many seats there are.
    """
    group = Window.partitionBy(*within)
    rows = rows.withColumns({"_v": F.sum(votes).over(group).cast("double"), "_n": F.count("*").over(group)})

    def up_to(n: Column) -> Column:
        wins = F.floor((F.col(votes) * (2 * F.col(seats) + n) / F.col("_v") + 1) / 2)
        return F.when(F.col("_v") > 0, F.greatest(wins, F.lit(0))).otherwise(0).cast("long")

    rows = rows.withColumn("_sure", F.greatest(up_to(-F.col("_n")) - 1, F.lit(0)))
    rows = rows.withColumn("_left", F.col(seats) - F.sum("_sure").over(group))
    tries = rows.select(
        *within, key, "_left", F.col(votes).alias("_votes"),
        F.explode(F.sequence(F.col("_sure") + 1, up_to(F.col("_n")) + 1)).alias("_k"),
    ).where("_votes > 0")
    best = group.orderBy((F.col("_votes") / (2 * F.col("_k") - 1)).desc(), F.col(key).asc_nulls_last(), "_k")
    won = tries.withColumn("_at", F.row_number().over(best)).where("_at <= _left")
    keys = list(dict.fromkeys([*within, key]))
    won = won.groupBy(*keys).agg(F.count("*").alias("_won"))
    won = won.select(*[F.col(c).alias(f"_of_{c}") for c in keys], "_won")
    same = F.lit(True)
    for c in keys:
        same &= F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    return rows.join(won, same, "left").select(
        *[c for c in rows.columns if not c.startswith("_")],
        (F.col("_sure") + F.coalesce("_won", F.lit(0))).alias("quota"),
    )


def mix(
    docs: DataFrame, weights=WEIGHTS, share: float = SHARE, repeats: int = REPEATS,
    seed: int = 20_240_501, shard_words: int = SHARD_WORDS, carry: tuple[str, ...] = (),
) -> DataFrame:
    """One row per row of ``docs(doc_id, text, source, ...)``: ``doc_id, source, size, source_size, target, taken``, and the columns in ``carry``.

    Null text has size 0, as has an empty one: nothing is taken of it. A null source
    is a source of its own. Rows that repeat a doc_id are documents of their own; a
    run again gives the same numbers. Documents go to shards by a hash of id and text, so that
    no shard has much more than ``shard_words`` words unless rows repeat both, or one text alone is longer. Sources
    and the shards of a source are ranked in one task, as rows of a few numbers: that holds
    for millions, not for a source to each document. No document is taken more than ``repeats`` times
    its size. An empty table gives no rows. Other columns aren't read.
    """
    own = F.xxhash64("doc_id", text_of(), F.lit(seed)).alias("hash")
    sizes = cut(docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count().alias("size"), own, *carry), "sizes")
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sources, weights, share, repeats)
    everything = Window.partitionBy()
    least = F.min(F.when(F.col("target") > 0, F.col("target"))).over(everything)
    targets = targets.withColumn("block", F.greatest(F.lit(1), F.least(F.lit(1024), F.floor(F.coalesce(least, F.lit(0.0)) / 256))).cast("long"))
    targets = targets.withColumn("seats", F.round(F.sum("target").over(everything) / F.col("block")).cast("long"))
    targets = cut(
        sainte_lague(targets.withColumn("all", F.lit(0)), "source", "target", "seats", ["all"])
        .drop("all", "seats", "weight")
        .withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words)).cast("long")),
        "targets",
    )
    named = targets.withColumnRenamed("source", "s")
    rows = sizes.join(named, F.col("source").eqNullSafe(F.col("s"))).drop("s", "quota")
    rows = rows.withColumn("shard", F.pmod(F.col("hash"), F.col("shards")))
    shards = rows.groupBy("source", "shard").agg(F.sum("size").alias("shard_size"))
    shards = shards.join(named, F.col("source").eqNullSafe(F.col("s"))).select(
        "source", "shard", "shard_size", F.col("quota").alias("seats"), "block"
    )
    shards = sainte_lague(shards, "shard", "shard_size", "seats", ["source"])
    shards = shards.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("shard_size") / F.col("block"))).cast("long"))
    shards = shards.withColumn("quota", F.least("quota", F.col("blocks") * repeats))
    shards = shards.select(
        F.col("source").alias("s"), F.col("shard").alias("h"),
        F.expr("quota div blocks").alias("rounds"),
        F.expr("quota % blocks").alias("more"),
        F.pmod(F.xxhash64("source", "shard", F.lit(seed + 1)), F.col("blocks")).alias("start"),
        "blocks",
    )
    order = Window.partitionBy("source", "shard").orderBy(F.xxhash64("doc_id", F.lit(seed + 2)), "doc_id", "hash", "size", *carry)
    rows = rows.withColumn("end", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.join(shards, F.col("source").eqNullSafe(F.col("s")) & (F.col("shard") == F.col("h")))

    def within(a: Column, b: Column) -> Column:
        return F.greatest(F.lit(0), F.least(F.col("end"), b * F.col("block")) - F.greatest(F.col("end") - F.col("size"), a * F.col("block")))

    start, stop = F.col("start"), F.col("start") + F.col("more")
    taken = F.col("rounds") * F.col("size") + within(start, F.least(stop, F.col("blocks"))) + within(F.lit(0), stop - F.col("blocks"))
    return rows.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"), *carry)
