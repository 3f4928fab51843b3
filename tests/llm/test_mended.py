"""Language prediction against a plain version, and samples that odd ids or vectors can't spoil."""

import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"


def plain_predict(model, text):
    """Language and cosine by the definition: trigrams one by one, sums in plain floats."""
    from meshlake.llm.langid import has_letter

    if not has_letter(text):
        return "und", 0.0
    raw = b" " + bytes(c if c >= 0x80 or 97 <= c <= 122 else 32 for c in text.lower().encode("utf-8", "replace")) + b" "
    seen = Counter()
    for k in range(len(raw) - 2):
        a, b, c = raw[k : k + 3]
        if b != 32 or (a != 32 and c != 32):
            seen[((a << 16 | b << 8 | c) * 2654435761 % 2**32) >> 20] += 1
    v = {k: math.log1p(n) * float(model.idf[k]) for k, n in seen.items()}
    size = math.sqrt(sum(x * x for x in v.values()))
    sims = [sum(x * float(c[k]) for k, x in v.items()) / size for c in model.centroids] if size else [0.0] * len(model.owner)
    best = max(range(len(sims)), key=lambda k: sims[k])
    return model.languages[model.owner[best]], min(1.0, max(0.0, sims[best]))


def test_language_of_every_document_by_the_definition(spark):
    from meshlake.llm.langid import fit, predict

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    odd = spark.createDataFrame([(10**6, None), (10**6 + 1, ""), (10**6 + 2, "123 ½"), (None, "été et l'hiver")], "doc_id bigint, text string")
    docs = docs.select("doc_id", "text", "lang").unionByName(odd.withColumn("lang", F.lit(None).cast("string")))
    model = fit(docs)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in predict(docs, model).collect():
        lang, score = plain_predict(model, texts[r["doc_id"]])
        assert (r["lang_pred"], round(r["score"], 4)) == (lang, round(score, 4)) or abs(r["score"] - score) < 1e-4


def test_repeated_and_null_ids_dont_swell_the_sample(spark):
    from meshlake.llm.langid import fit, predict

    rng = np.random.default_rng(2)
    words = {lang: ["".join(rng.choice(list(letters), 5)) for _ in range(50)] for lang, letters in (("aa", "abcdefg"), ("zz", "tuvwxyz"))}
    rows = [(None if k % 2 else 4, " ".join(rng.choice(words[lang], 20)), lang) for lang in words for k in range(2000)]
    rows += [(None, rows[0][1], "aa")] * 3000
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = fit(docs, max_sample=64)
    assert model.languages == ["aa", "zz"]
    found = predict(docs, model).select("lang_pred").collect()
    assert sum(f["lang_pred"] == r[2] for f, r in zip(found, rows, strict=True)) > 0.99 * len(rows)


def test_zero_vectors_of_another_length_change_nothing(spark):
    from meshlake.llm.ann import search

    rng = np.random.default_rng(3)
    rows = [(n, rng.normal(size=8).tolist()) for n in range(50)]
    bad = [(1000 + n, [0.0] * 5) for n in range(400)] + [(2000 + n, [float("nan")] * 3) for n in range(400)]
    one, two = (
        sorted(tuple(r) for r in search(spark.createDataFrame(own, "vec_id long, embedding array<double>"), F.col("vec_id") < 5, share=1.0).collect()) for own in (rows, rows + bad)
    )
    assert one == two and len(one) == 50


def test_driver_holds_no_whole_vectors_of_the_sample(spark):
    """Language id made several tables of the sample by all dimensions at once; now one language's vectors at a time."""
    import tracemalloc

    from meshlake.llm import langid

    words = {"aa": "alpha beta gamma", "bb": "delta epsilon zeta", "cc": "eta theta iota", "dd": "kappa lambda mu"}
    docs = spark.createDataFrame([(n, f"{words[lang]} {n} {lang}", lang) for n in range(4000) for lang in [sorted(words)[n % 4]]], "doc_id long, text string, lang string")
    tracemalloc.start()
    try:
        model = langid.fit(docs)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert model.languages == sorted(words)
    assert peak < 2400 * langid.DIMS * 4 * 0.75  # about 2,670 documents are learned from
