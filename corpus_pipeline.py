"""From raw documents to tokens: language id, exact and near deduplication, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``docs``. Between stages the rows are written as Parquet.

A stage decides on narrow rows that carry the place of a document in its table, and
the documents meet these decisions once, by place. In every stage a null text is an empty
one, null ids and sources are values like others, texts of any length are taken whole, extra columns of
any name come through unchanged, and an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshlake.llm.common import cut
from meshlake.llm.components import connected_components
from meshlake.llm.exact import exact_dedup
from meshlake.llm.forest import near_duplicates as similar_sets
from meshlake.llm.langid import fit, keep_known
from meshlake.llm.mixing import mix
from meshlake.llm.simhash import near_duplicates
from meshlake.llm.spm import encode_decode

#: SQL can't express most stages; a brute-force version stands in the tests.
ORACLE_SQL = None
#: Decisions of two numbers each are sent to all executors up to this many rows, about 10 MB; beyond, both sides are dealt by place.
MAX_SENT = 100_000
#: Hundredths of their five-word shingles that near copies share at least.
SIMILARITY = 80
_PLACE = ("place_file", "place_row")


def _placed(docs: DataFrame) -> DataFrame:
    """``row`` (a struct of all columns, so that none can clash with a name used here) and the place of each row, two numbers.

    A place is the file (by hash of its path) and the row's number in it, so no two reads can differ. Rows that don't
    come straight from files are written to a table first.
    """
    if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation":
        meta = docs.metadataColumn("_metadata")
        file, row = F.xxhash64(meta["file_path"]), meta["row_index"]
        return docs.select(F.struct("*").alias("row"), file.alias("place_file"), row.alias("place_row"))
    rows = docs.select(F.struct("*").alias("row"), F.lit(0).cast("long").alias("place_file"), F.monotonically_increasing_id().alias("place_row"))
    return cut(rows, "placed")


def _narrow(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.select(*[F.col("row")[c].alias(c) for c in columns], *_PLACE)


def _without(rows: DataFrame, dropped: DataFrame) -> DataFrame:
    """The documents whose places aren't among ``dropped``."""
    gone = cut(dropped.select(*_PLACE), "dropped")
    gone = F.broadcast(gone) if gone.count() <= MAX_SENT else gone.hint("merge")
    return rows.join(gone, [*_PLACE], "left_anti").select("row.*")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; those that every centroid rejects go, as do texts without a letter.

    Repeated rows fare alike.
    """
    return keep_known(docs, fit(docs))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each normalised text: the one with the smallest doc_id, null last; of rows that share that too, the first by place."""
    rows = _placed(docs)
    return _without(rows, exact_dedup(_narrow(rows, "doc_id", "text"), carry=_PLACE).where("NOT kept"))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near-duplicates: the one with the smallest doc_id, null last, then the first by place.

    Two kinds of links make components: fingerprints at most two bits apart, and, since these miss most near copies, sets of five-word shingles
    that have at least ``SIMILARITY`` hundredths in common, confirmed on the full sets. Texts without words are one component.
    """
    rows = _placed(docs)
    texts = _narrow(rows, "doc_id", "text")
    by_bits = near_duplicates(texts, carry=_PLACE).select("doc_id", F.concat(F.lit("f"), "root").alias("f"), *_PLACE)
    by_sets = similar_sets(texts, similarity=SIMILARITY, carry=_PLACE).select(F.concat(F.lit("s"), F.col("root").cast("string")).alias("s"), *_PLACE)
    found = cut(by_bits.join(by_sets, [*_PLACE]), "components")
    # Only groups of several rows can be part of one another.
    many = [cut(found.where(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("n")).where("n > 1").select(c), f"many-{c}") for c in "fs"]
    shared = cut(found.join(many[0], "f", "left_semi").unionByName(found.join(many[1], "s", "left_semi")).distinct(), "shared")
    roots = connected_components(shared.where("s IS NOT NULL").select(F.col("f").alias("a"), F.col("s").alias("b")))
    grouped = shared.join(roots.withColumnRenamed("node", "f"), "f", "left").withColumn("root", F.coalesce("root", "f"))
    place = F.struct(F.col("doc_id").isNull(), "doc_id", *_PLACE)
    kept = grouped.groupBy("root").agg(F.min(place).alias("kept"), F.count("*").alias("n")).where("n > 1").select("root", "kept")
    return _without(rows, grouped.join(kept, "root").where(place != F.col("kept")))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them: the words taken over the row's size, rounded. Rows without words go.

    Repeated rows are taken each for itself.
    """
    rows = _placed(docs)
    mixed = mix(_narrow(rows, "doc_id", "text", "source"), carry=_PLACE)
    times = F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(0).cast("int").alias("times")
    taken = rows.join(mixed.select(*_PLACE, times).where("times > 0"), [*_PLACE])
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids with the end id, and digests of ids and decoded text, for each row; a text without characters has the end id alone."""
    made = encode_decode(docs)
    return made.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        "ids",
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("language id", language_id),
    ("exact dedup", exact_dedup_stage),
    ("simhash near-dedup", simhash_stage),
    ("mix sources", mix_stage),
    ("sentencepiece", encode_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
