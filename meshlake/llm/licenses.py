"""Licence scan with ordered signature rules.

A text becomes a string of words, A-Z in lower case. The rules whose keywords it
contains are matched in order of priority. The words of a detection are taken:
they are written in capitals, with a mark before the first and after the last, so
that a worse rule finds nothing inside the interval or across its ends, but
still finds what stands beside it. Each rule costs one pass over the text,
however often it matches.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshlake.llm.common import ascii_lower, text_of
from meshlake.llm.license_rules import BASE, RULES, Rule

#: What stands between words (of a text in lower case).
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Marks before a detection, after its rule's number, and behind it: no word has such characters.
OPEN, NUMBER, CLOSE = "\x01", "\x02", "\x03"


def _expression(pattern: Column) -> Column:
    """A rule as a regular expression on words that have a space before and after each."""
    return F.concat(F.lit(" (?:"), pattern, F.lit(")(?= )"))


def _take(line: Column, pattern: Column, number: Column) -> Column:
    """``line`` with all places of a rule marked and in capitals."""
    between, own = F.split(line, pattern, -1), F.regexp_extract_all(line, pattern, F.lit(0))

    def marked(match: Column) -> Column:
        words = F.translate(F.substring(match, 2, 2**31 - 1), "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
        return F.concat(F.lit(" " + OPEN), number, F.lit(NUMBER), words, F.lit(CLOSE))

    pairs = F.zip_with(between, own, lambda b, m: F.concat(b, F.when(m.isNull(), F.lit("")).otherwise(marked(m))))
    return F.array_join(pairs, "")


def _intervals(line: Column) -> Column:
    """``start, stop, number`` of the marked places, words from 0, stop exclusive."""
    tokens = F.split(line, " ")  # the first is empty: word k is token k + 1
    first = F.array_compact(
        F.transform(
            tokens,
            lambda t, k: F.when(F.startswith(t, F.lit(OPEN)), F.struct((k - 1).alias("start"), F.substring_index(F.substring(t, 2, 2**31 - 1), NUMBER, 1).cast("int").alias("number"))),
        )
    )
    stops = F.array_compact(F.transform(tokens, lambda t, k: F.when(F.endswith(t, F.lit(CLOSE)), k)))
    return F.zip_with(first, stops, lambda a, b: F.struct(a["start"].alias("start"), b.alias("stop"), a["number"].alias("number")))


def _scan(line: Column, rules: Column) -> Column:
    """Intervals of the ``rules`` (structs of ``number, pattern``, in order) in a line of words."""

    def one(state: Column, rule: Column) -> Column:
        pattern = _expression(rule["pattern"])
        return F.when(F.rlike(state, pattern), _take(state, pattern, rule["number"].cast("string"))).otherwise(state)

    return _intervals(F.aggregate(rules, line, one))


def _named(found: Column, labels: list[str]) -> Column:
    names = F.array(*map(F.lit, labels))
    return F.transform(
        found,
        lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop"), x["number"].alias("priority"), F.element_at(names, x["number"] + 1).alias("label")),
    )


def license_scan(docs: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """One row per row of ``docs(doc_id, text, ...)``: ``doc_id, n_words, base, detections``.

    ``base`` has the intervals of all places of base phrases, whatever else is found there.
    ``detections`` are the intervals ``start, stop, priority, label`` (words from 0, stop exclusive,
    in order of place) that the rules find, the best first, each among the words that better
    ones have left; of one rule they are leftmost and don't overlap. Null text is empty; texts without
    words have no detections; repeated rows and null ids are rows like others; an empty table
    gives no rows; other columns aren't read. Whole texts are searched, of any length.
    """
    line = F.concat(F.lit(" "), F.trim(F.regexp_replace(ascii_lower(text_of()), GAP, " ")), F.lit(" "))
    rows = docs.select("doc_id", line.alias("line"))
    # A rule is looked up by the keyword that the fewest rules have.
    often = Counter(k for r in rules for k in r.keywords)
    by_anchor: dict[str, list[Rule]] = {}
    for r in rules:
        by_anchor.setdefault(min(r.keywords, key=lambda k: (often[k], -len(k))), []).append(r)
    phrases = [Rule(k, label, tuple(phrase.split()), phrase) for k, (phrase, label) in enumerate(BASE)]
    vocabulary = sorted(often.keys() | {k for r in phrases for k in r.keywords})

    def struct(r: Rule) -> Column:
        return F.struct(F.lit(r.priority).alias("number"), F.lit(r.pattern).alias("pattern"), F.array(*map(F.lit, r.keywords)).alias("keywords"))

    def possible(own: Column) -> Column:
        return F.filter(own, lambda r: F.size(F.array_except(r["keywords"], F.col("present"))) == 0)

    anchors = F.array(*map(F.lit, by_anchor))
    lookup = F.map_from_arrays(anchors, F.array(*[F.array(*map(struct, own)) for own in by_anchor.values()]))
    chosen = F.flatten(F.transform(F.array_intersect(F.col("present"), anchors), lambda w: F.element_at(lookup, w)))
    rows = rows.withColumn("present", F.array_intersect(F.split("line", " "), F.array(*map(F.lit, vocabulary))))
    rows = rows.withColumns(
        {"rules": F.array_sort(possible(chosen)), "phrases": possible(F.array(*map(struct, phrases)))}
    )
    n = F.char_length("line") - F.char_length(F.replace(F.col("line"), F.lit(" "))) - 1
    nothing = F.array().cast("array<struct<start:int,stop:int,number:int>>")
    return rows.select(
        "doc_id",
        F.when(F.char_length("line") > 2, n).otherwise(0).cast("long").alias("n_words"),
        _named(F.when(F.size("phrases") > 0, _scan(F.col("line"), F.col("phrases"))).otherwise(nothing), [r.label for r in phrases]).alias("base"),
        _named(F.when(F.size("rules") > 0, _scan(F.col("line"), F.col("rules"))).otherwise(nothing), [r.label for r in rules]).alias("detections"),
    )
