"""Spelling variants grouped with the frequent words they are near to.

Words within one edit are found by a rare-first prefix filter. One edit destroys at most two bigrams of a
word. Order the bigrams of every word by how rare they are among all words, then by place: of the first three at
least one survives the edit, and the first survivor is the same in both words, as the order of survivors
is. So each word is listed under its three rarest bigrams only; two words within one edit meet under one of
them. Its place is limited by the length of what is before it, if the edit is behind, or of what is behind
it, if the edit is before; and what is on that side is equal.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshlake.llm.common import cut, small_batches, text_of, tidy

#: What runs are made of, when A-Z are in lower case.
LETTERS = "[a-zÀ-ÿ]"
#: A run loses a character if this divides its hash; words have so many code points and occurrences at least.
DIVISOR, LEAST_CHARS, LEAST_COUNT = 31, 7, 2
#: A form is so many times as frequent as the word.
RATIO = 10
#: Counted words that a worker holds before it passes them on.
MAX_HELD = 200_000
#: Bigrams whose frequencies are sent to all executors, about 5 MB.
MAX_SENT = 100_000
#: Bigrams under which a word is listed: one more than an edit can destroy.
PREFIX = 3


def altered(doc_id: str, run: str, divisor: int = DIVISOR) -> str:
    """A lower-case run as it is counted: without one of its characters if ``divisor`` divides the CRC-32 of ``doc_id:run``."""
    from zlib import crc32

    h = crc32(f"{doc_id}:{run}".encode())
    if h % divisor:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT, divisor: int = DIVISOR) -> DataFrame:
    """``word, n``: the words of all texts that have the given length and frequency.

    Null text has none; a null id counts as an empty string. Runs are counted per batch before they are shuffled.
    """
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        runs, held = re.compile(f"{LETTERS}{{{least_chars},}}"), Counter()  # shorter runs can't become words

        def taken() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                lowered = text.encode().lower().decode()  # of bytes, only A-Z
                for word, n in Counter(map(re.Match.group, runs.finditer(lowered))).items():
                    word = altered(doc_id, word, divisor)
                    if len(word) >= least_chars:
                        held[word] += n
                if len(held) > MAX_HELD:
                    yield taken()
        if held:
            yield taken()

    small_batches(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), text_of().alias("text"))
    return rows.mapInArrow(tidy(run), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def near_words(words: DataFrame) -> DataFrame:
    """``a, b``: all ordered pairs of different words of ``words(word)`` that are exactly one edit apart; words have three characters at least."""
    at = F.sequence(F.lit(1), F.char_length("word") - 1)
    grams = words.select("word", F.explode(F.transform(at, lambda k: F.struct(F.substring("word", k, F.lit(2)).alias("gram"), k.alias("place")))).alias("g"))
    grams = grams.select("word", "g.gram", "g.place")
    often = cut(grams.groupBy("gram").agg(F.count("*").alias("often")), "bigrams")
    # Of letters, there are 8,100 bigrams at most. Other words may have more: then both sides are dealt by bigram.
    often = F.broadcast(often) if often.count() <= MAX_SENT else often
    listed = grams.join(often, "gram").groupBy("word").agg(F.array_sort(F.collect_list(F.struct("often", "gram", "place"))).alias("order"))
    # The third matters only if one edit can destroy the two before it, and bigrams destroyed together are neighbours.
    order, two = F.col("order"), F.slice("order", 1, PREFIX - 1)
    side_by_side = F.abs(order[0]["place"] - order[1]["place"]) == 1
    listed = listed.select("word", F.inline(F.when(side_by_side, F.slice("order", 1, PREFIX)).otherwise(two)))
    # The edit is before the shared bigram or behind it: what is on the other side is equal in both words.
    before = F.substring("word", F.lit(1), F.col("place") - 1)
    behind = F.substring("word", F.col("place") + 2, F.char_length("word"))
    sides = F.array(F.struct(F.lit("before").alias("side"), before.alias("equal")), F.struct(F.lit("behind").alias("side"), behind.alias("equal")))
    bits = F.transform(F.split("word", ""), lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), F.ascii(c) % 64))
    letters = F.aggregate(bits, F.lit(0).cast("long"), lambda x, y: x.bitwiseOR(y))
    listed = cut(listed.select("word", F.char_length("word").alias("chars"), letters.alias("letters"), "gram", F.inline(sides)), "prefixes")
    # The shorter word, or the smaller of two of one length, looks for the other.
    looking = listed.select(F.col("word").alias("a"), F.col("letters").alias("own"), "gram", "side", "equal", "chars", F.explode(F.array(F.lit(0), F.lit(1))).alias("more"))
    looking = looking.withColumn("chars", F.col("chars") + F.col("more"))
    met = looking.join(listed.withColumnRenamed("word", "b"), ["gram", "side", "equal", "chars"]).where("more = 1 OR a < b")
    met = met.where(F.bit_count(F.col("own").bitwiseXOR(F.col("letters"))) <= 2)  # one edit changes two letters at most
    pairs = met.where(F.levenshtein("a", "b", 1) == 1).select("a", "b").distinct()
    both = F.array(F.struct(F.col("a").alias("a"), F.col("b").alias("b")), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    return pairs.select(F.inline(both))


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for each row of ``words(word, n)``, whose words are distinct.

    ``form`` is the near word of largest n (ties: the smallest), if that is ``ratio`` times the word's own n at least;
    ``root`` is where forms lead in the end. An empty table gives no rows.
    """
    if ratio < 2:
        raise ValueError("ratio must be at least 2, or forms could lead in circles")
    pairs = near_words(words)
    # n falls along the order of the struct, so that the smallest struct is the largest n's, smallest word.
    best = pairs.join(words.select(F.col("word").alias("b"), F.col("n").alias("b_n")), "b").groupBy("a").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("b_n")).alias("less"), F.col("b").alias("word"))).alias("best")
    )
    rows = words.join(best.withColumnRenamed("a", "word"), "word", "left")
    has = -F.col("best.less") >= F.col("n") * ratio
    rows = rows.select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(has, F.col("best.word")).alias("form"), F.when(has, -F.col("best.less")).alias("form_n"),
    )
    rows = cut(rows, "forms")
    # n grows by the ratio with each form, so a chain has no more links than this; each turn doubles what is followed.
    most, links = rows.agg(F.max("n")).first()[0] or 0, 0
    while ratio**links <= most:
        links += 1
    chain = rows.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    for _ in range(links.bit_length()):
        further = chain.select(F.col("word").alias("root"), F.col("root").alias("next"))
        chain = cut(chain.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
    return rows.join(chain, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT, ratio: int = RATIO) -> DataFrame:
    """:func:`variants` of the words of ``docs(doc_id, text, ...)``, which has one row for each word.

    Null and empty texts have no words; repeated rows count each time; an empty table gives no rows; other columns aren't
    read. Texts of any length are read whole, and a worker's memory depends on the distinct runs of one text.
    """
    if least_chars < PREFIX + 1:
        raise ValueError(f"words need {PREFIX + 1} characters at least, so that they have {PREFIX} bigrams")
    return variants(cut(word_counts(docs, least_chars, least_count), "words"), ratio)
