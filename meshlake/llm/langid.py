"""Language identification by nearest centroid.

A text is the vector of its byte trigrams (letters in lower case, everything
else a gap), hashed to a fixed number of dimensions, weighted by TF-IDF and
normalised. Each language has several centroids, clustered from a sample of
labelled documents; a text gets the language of the centroid with the largest
cosine, and is rejected if even that is far away.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshlake.llm.common import small_batches, tidy

#: Vector dimensions, centroids per language, and the documents of the training sample; more only if there are more languages.
DIMS, CENTROIDS, MAX_SAMPLE = 4096, 4, 4096
#: A text is rejected below this share of the least cosine that all but one in 200 training documents have.
REJECT = 0.5
UNKNOWN = "und"
_ALNUM = re.compile(r"[^\W\d_]")
_GAPS = bytes(c if c >= 0x80 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))
_AT_ONCE = 1 << 18


def has_letter(text: str | None) -> bool:
    """Whether a text has a letter. Numerals such as ½ and Ⅲ match the pattern too, but are none."""
    return bool(text) and any(m[0].isalpha() for m in _ALNUM.finditer(text))


def counts(text: str, dims: int = DIMS) -> np.ndarray:
    """Hashed trigram counts of a whole text."""
    raw = b" " + text.lower().encode("utf-8", "replace").translate(_GAPS) + b" "
    out = np.zeros(dims, dtype=np.int64)
    for at in range(0, len(raw) - 2, _AT_ONCE):
        b = np.frombuffer(raw, dtype=np.uint8, offset=at, count=min(_AT_ONCE + 2, len(raw) - at)).astype(np.uint32)
        code = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
        code = code[(b[1:-1] != 0x20) | ((b[:-2] != 0x20) & (b[2:] != 0x20))]
        out += np.bincount((code * np.uint32(2654435761)) >> np.uint32(32 - dims.bit_length() + 1), minlength=dims)
    return out


@dataclass(frozen=True)
class Model:
    """Its size goes with the number of languages, not of documents: idf, centroids (rows), the language of each, and the cosine below which texts are rejected."""

    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    owner: np.ndarray
    least: float

    def vectors(self, rows: np.ndarray) -> np.ndarray:
        v = np.log1p(rows).astype(np.float32) * self.idf
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, cosine and rejection of each text."""
        out = [UNKNOWN] * len(texts)
        score, rejected = np.zeros(len(texts)), np.ones(len(texts), dtype=bool)
        ok = [k for k, t in enumerate(texts) if has_letter(t)] if self.languages else []
        for at in range(0, len(ok), 256):
            part = ok[at : at + 256]
            sims = self.vectors(np.stack([counts(texts[k], len(self.idf)) for k in part])) @ self.centroids.T
            best = sims.argmax(axis=1)
            for k, b, s in zip(part, best, sims[np.arange(len(part)), best], strict=True):
                out[k] = self.languages[self.owner[b]]
                score[k] = min(1.0, max(0.0, float(s)))
                rejected[k] = s < self.least
        return out, score, rejected


def _cluster(v: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means; starts from the vector nearest to the mean, then each time the one farthest from all."""
    chosen = [int((v @ v.mean(axis=0)).argmax())]
    near = v @ v[chosen[0]]
    while len(chosen) < min(k, len(v)):
        chosen.append(int(near.argmin()))
        near = np.maximum(near, v @ v[chosen[-1]])
    c = v[chosen]
    for _ in range(15):
        at = (v @ c.T).argmax(axis=1)
        c = np.stack([v[at == j].mean(axis=0) if (at == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def held_out(column: str = "doc_id") -> Column:
    """Whether a document is never learned from: crc32 of the id as text, modulo 3, is 1. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, seed: int = 7, max_sample: int = MAX_SAMPLE) -> Model:
    """Learn from text and lang of documents that aren't held out.

    Every language is learned that has a text with a letter. The sample is at most ``max_sample`` documents
    (whole texts), as many of each language but one at least, chosen by a hash of id and text; their trigram counts
    are made on the executors. Rows with equal id, text and lang are learned from once, so that repeated and null ids
    can't swell the sample. An empty table gives a model that knows no language.
    """
    import pyarrow as pa

    rows = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    by_size = rows.groupBy("lang").agg(F.count("*").alias("n"))
    n_languages = by_size.count()
    if not n_languages:
        return Model([], np.ones(DIMS, np.float32), np.zeros((0, DIMS), np.float32), np.zeros(0, int), 0.0)
    each = max(1, max_sample // n_languages)
    wide = 1 << 30
    share = by_size.select("lang", (F.lit(wide) * F.least(F.lit(1.0), F.lit(1.2 * (each + 8)) / F.col("n"))).cast("long").alias("below"))
    own = F.xxhash64(F.col("doc_id").cast("string"), "text", F.lit(seed))
    rows = rows.select("lang", "text", F.pmod(own, F.lit(wide)).alias("order"), own.alias("own"))
    drawn = rows.join(F.broadcast(share), "lang").where(F.col("order") < F.col("below"))
    drawn = drawn.groupBy("lang", "own").agg(F.first("text").alias("text"), F.first("order").alias("order")).select("lang", "text", "order")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, where, n = [], [], []
            for k, t in enumerate(batch.column(1).to_pylist()):
                if has_letter(t):
                    c = counts(t)
                    at = np.flatnonzero(c)
                    kept.append(k)
                    where.append(at.astype(np.uint16).tobytes())
                    n.append(c[at].astype(np.uint32).tobytes())
            take = pa.array(kept, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(2).take(take), pa.array(where, pa.binary()), pa.array(n, pa.binary())],
                names=["lang", "order", "at", "n"],
            )

    small_batches(docs.sparkSession)
    names = "lang string, order bigint, at binary, n binary"
    sample = drawn.mapInArrow(tidy(run), names).collect()
    if len(found := {r["lang"] for r in sample}) < n_languages:  # none drawn, or none of those has a letter: look at all their rows
        known = docs.sparkSession.createDataFrame([(x,) for x in sorted(found)], "lang string")
        first = Window.partitionBy("lang").orderBy("order", "at", "n")
        rest = rows.join(F.broadcast(known), "lang", "left_anti").mapInArrow(tidy(run), names)
        sample += rest.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= each).drop("nth").collect()
    sample.sort(key=lambda r: (r["lang"], r["order"], bytes(r["at"]), bytes(r["n"])))
    chosen: dict[str, list] = {}
    for r in sample:
        if len(own := chosen.setdefault(r["lang"], [])) < each:
            own.append(r)
    del sample
    languages = sorted(chosen)
    if not languages:
        return Model([], np.ones(DIMS, np.float32), np.zeros((0, DIMS), np.float32), np.zeros(0, int), 0.0)
    # The driver holds the sample as it came, by trigrams that occur; whole vectors of one language at a time.
    n_rows, df = sum(map(len, chosen.values())), np.zeros(DIMS, dtype=np.int64)
    for r in (r for own in chosen.values() for r in own):
        df[np.frombuffer(bytes(r["at"]), np.uint16)] += 1
    idf = np.log((1 + n_rows) / (1 + df)).astype(np.float32) + np.float32(0.1)
    owner, centroids, near = [], [], []
    for k, lang in enumerate(languages):
        own = np.zeros((len(chosen[lang]), DIMS), dtype=np.float32)
        for v, r in zip(own, chosen[lang], strict=True):
            at = np.frombuffer(bytes(r["at"]), np.uint16)
            v[at] = np.log1p(np.frombuffer(bytes(r["n"]), np.uint32).astype(np.float32)) * idf[at]
            v /= max(np.linalg.norm(v), 1e-12)
        c = _cluster(own, CENTROIDS)
        centroids.append(c)
        owner += [k] * len(c)
        near.append((own @ c.T).max(axis=1))
        del own
    least = REJECT * float(np.quantile(np.concatenate(near), 1 / 200))
    return Model(languages, idf, np.concatenate(centroids), np.array(owner), least)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of ``docs(doc_id, text, ...)``: ``doc_id, held_out, lang_pred, score, rejected``.

    ``und`` with score 0, rejected, if the text is null or has no letter, or nothing was
    learned. Otherwise a learned language with its cosine; ``rejected`` tells that all
    centroids are too far. Of languages with the same cosine the first in order of code points is taken. Repeated rows and null ids are rows like others; whole texts
    of any length count; an empty table gives no rows; other columns aren't read.
    """
    import pyarrow as pa

    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score, rejected = shared.value.predict(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)],
                names=["doc_id", "held_out", "lang_pred", "score", "rejected"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tidy(run), f"doc_id {kind}, held_out boolean, lang_pred string, score double, rejected boolean")


def keep_known(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs(text, ...)``, with all their columns, that :func:`predict` doesn't reject: null texts go; an empty table stays empty."""
    import pyarrow as pa

    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, _, rejected = shared.value.predict(batch.column(at).to_pylist())
            yield batch.filter(pa.array(~rejected))

    return docs.mapInArrow(tidy(run), docs.schema)
