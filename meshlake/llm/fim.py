"""Fill-in-middle transformation: a text is cut at two unit ends, and its middle moves behind its suffix.

The ends of all units are collected in one compact array of code-point offsets; the two cuts are lookups in it.
Which units, and which form, follow from a digest of the document's id, so that reruns and retries agree.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshlake.llm.common import small_batches, text_of

#: Units are lines, with their line end.
LINES = r"[^\n]*\n|[^\n]+"
PLAIN, PSM, SPM = "plain", "psm", "spm"
SCHEMA = "form string, n long, prefix_chars long, middle_chars long, output string"


@dataclass(frozen=True)
class Markers:
    """Strings that stand before prefix, suffix and middle.

    A text that holds one of them stays plain. So that a marker can't arise where two pieces
    meet, each starts with a character that none of them holds further on.
    """

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self):
        own = (self.prefix, self.suffix, self.middle)
        if len(set(own)) < 3 or not all(own) or any(a[0] in b[1:] for a in own for b in own):
            raise ValueError("markers must be three different strings whose first characters occur in none of them again")


def draws(doc_id: int | None, seed: int) -> tuple[int, int, int, int]:
    """The first four 8-digit groups of the hex SHA-256 of ``seed:doc_id``, as numbers; a null id counts as an empty string."""
    import hashlib

    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[k : k + 4], "big") for k in (0, 4, 8, 12))


def unit_ends(text: str, units) -> array:
    """Offsets at which units end, with 0 in front; ``units`` is a compiled expression of the regex library."""
    ends = array("q", [0])
    ends.extend(m.end() for m in units.finditer(text))
    return ends


def transform(text: str, doc_id: int | None, units, seed: int, fim_rate: int, spm_rate: int, markers: Markers) -> tuple:
    """``form, n, prefix_chars, middle_chars, output`` of one text."""
    ends = unit_ends(text, units)
    n = len(ends) - 1
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not text or any(m in text for m in (markers.prefix, markers.suffix, markers.middle)) or h3 % 100 >= fim_rate:
        return PLAIN, n, None, None, text
    first, last = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = ends[first], ends[last]
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm_rate:
        return SPM, n, a, b - a, f"{markers.suffix}{suffix}{markers.prefix}{prefix}{markers.middle}{middle}"
    return PSM, n, a, b - a, f"{markers.prefix}{prefix}{markers.suffix}{suffix}{markers.middle}{middle}"


def restore(output: str, form: str, markers: Markers = Markers()) -> str:
    """The text from which ``output`` was made; ValueError if it doesn't have the given form."""
    if form == PLAIN:
        return output
    if form not in (PSM, SPM):
        raise ValueError(f"unknown form {form!r}")
    first, second = (markers.prefix, markers.suffix) if form == PSM else (markers.suffix, markers.prefix)
    at, end = output.find(second), output.find(markers.middle)
    if not output.startswith(first) or not 0 < at < end:
        raise ValueError(f"not in form {form}")
    one, two, middle = output[len(first) : at], output[at + len(second) : end], output[end + len(markers.middle) :]
    return one + middle + two if form == PSM else two + middle + one


def fill_in_middle(
    docs: DataFrame, units: str = LINES, seed: int = 7, fim_rate: int = 100, spm_rate: int = 50, markers: Markers = Markers()
) -> DataFrame:
    """One row per row of ``docs(doc_id, text, ...)``: ``doc_id, form, n, prefix_chars, middle_chars, output``.

    ``units`` is an expression that matches a text from end to end in pieces. ``fim_rate`` in a hundred texts are
    cut, ``spm_rate`` in a hundred of those start with the suffix. Null text is empty and stays plain, with null
    lengths; a null id is one value like another; repeated rows give equal results; an empty table
    gives no rows; other columns aren't read. Texts are taken whole.
    """
    @F.pandas_udf(SCHEMA)
    def moved(rows: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        import regex

        compiled, names = regex.compile(units), ["form", "n", "prefix_chars", "middle_chars", "output"]
        for ids, texts in rows:
            own = [None if pd.isna(i) else int(i) for i in ids]
            out = [transform(t, i, compiled, seed, fim_rate, spm_rate, markers) for i, t in zip(own, texts, strict=True)]
            yield pd.DataFrame(out, columns=names).astype({"n": "int64", "prefix_chars": "Int64", "middle_chars": "Int64"})

    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", moved(F.col("doc_id").cast("long").cast("string"), text_of()).alias("made"))
    return rows.select("doc_id", "made.*")


def restored(made: DataFrame, markers: Markers = Markers()) -> DataFrame:
    """``made`` and a column ``text``: rebuilt from ``output`` and ``form`` alone. A null output is null again; an empty table gives no rows."""
    @F.pandas_udf("string")
    def back(outputs: pd.Series, forms: pd.Series) -> pd.Series:
        return pd.Series([None if o is None else restore(o, f, markers) for o, f in zip(outputs, forms, strict=True)], dtype=object)

    return made.withColumn("text", back("output", "form"))
