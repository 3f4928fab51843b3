"""The pipeline, stage by stage, against plain versions of what each decides."""

import hashlib
import random
import re
from collections import Counter
from itertools import combinations

import pytest
from test_new_operators import planted, shingles
from test_operators import plain_fp, plain_lague, plain_targets

corpus_pipeline = pytest.importorskip("corpus_pipeline")
DATA = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet").cache()


def ids(df):
    return Counter(r["doc_id"] for r in df.select("doc_id").collect())


def plain_groups(rows):
    """The smallest id that links reach, for each (id, text): fingerprints two bits apart, or four fifths of five-word shingles in common."""
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    fps, sets = [plain_fp(t) for _, t in rows], [shingles(t) for _, t in rows]
    for i, j in combinations(range(len(rows)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= 2 or sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            up[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(i, least.get(find(k), i))
    return {i: least[find(k)] for k, (i, _) in enumerate(rows)}


def test_stages_keep_columns_and_take_effect(spark, docs):
    from meshlake.llm.exact import exact_dedup
    from meshlake.llm.mixing import mix

    stages = dict(corpus_pipeline.STAGES)
    known = stages["language id"](spark, docs, DATA)
    assert known.columns == docs.columns and known.count() == docs.count()
    once = stages["exact dedup"](spark, docs, DATA)
    assert once.columns == docs.columns
    assert ids(once) == ids(exact_dedup(docs).where("kept"))
    apart = stages["simhash near-dedup"](spark, docs, DATA)
    assert apart.columns == docs.columns
    least = plain_groups([(r["doc_id"], r["text"] or "") for r in docs.collect()])
    assert ids(apart) == Counter(i for i in least if least[i] == i)
    mixed = stages["mix sources"](spark, docs, DATA)
    assert mixed.columns == docs.columns
    times = {r["doc_id"]: (r["taken"], r["size"]) for r in mix(docs).collect()}
    assert ids(mixed) == Counter({i: n for i, (t, s) in times.items() if s and (n := int(t / s + 0.5))})


def test_repeated_and_null_rows(spark):
    rows = [(1, "a b c d", "en", "s", 7), (1, "a b c d", "en", "s", 7), (1, "other words here now", "en", "s", 7), (None, "a  b c d", "en", "s", 7), (None, None, None, None, None), (2, "", "en", None, 0)]
    df = spark.createDataFrame(rows, DOCS)
    stages = dict(corpus_pipeline.STAGES)
    kept = [(r["doc_id"], r["text"]) for r in stages["exact dedup"](spark, df, DATA).collect()]
    assert Counter(kept) == Counter([(1, "a b c d"), (1, "other words here now"), (2, "")])
    apart = [(r["doc_id"], r["text"]) for r in stages["simhash near-dedup"](spark, df, DATA).collect()]
    assert Counter(apart) == Counter([(1, "a b c d"), (1, "other words here now"), (2, "")])
    mixed = stages["mix sources"](spark, df, DATA)
    assert set(r["text"] for r in mixed.collect()) <= {"a b c d", "a  b c d", "other words here now"}
    none = spark.createDataFrame([], DOCS)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, DATA).count() == 0


@pytest.mark.parametrize("changed", [1, 4])
def test_near_copies_go_and_others_stay(spark, changed):
    """Copies of texts of 200 words in which some words are changed; texts that are near to none stay."""
    df, rows = planted(spark, random.Random(changed), 120, 1, changed)
    df = df.selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source", "length(text) AS n_chars")
    kept = ids(dict(corpus_pipeline.STAGES)["simhash near-dedup"](spark, df, DATA))
    copies = [i for i, _ in rows if i < 500_000 and i % 1000]
    assert sum(i not in kept for i in copies) >= 0.99 * len(copies)
    assert all(kept[i] == 1 for i, _ in rows if i not in copies)


def test_columns_with_clashing_names(spark):
    """Names that stages use inside are columns like others, and keep their values."""
    extra = ["sha", "s", "f", "root", "n", "hi", "lo", "row", "result", "nth_l", "id_l", "sha_r", "kept", "size", "taken", "uid", "block", "fp", "name", "held_out"]
    words = ["alpha beta gamma delta", "alpha  beta gamma delta", "one two three four five six", "red green blue"]
    rows = [(k, t, "en", "s", len(t), *[f"{c}{k}" for c in extra]) for k, t in enumerate(words)]
    df = spark.createDataFrame(rows, DOCS + "".join(f", {c} string" for c in extra))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, df, DATA)
        assert made.columns == df.columns, name
        for r in made.collect():
            assert [r[c] for c in extra] == [f"{c}{r['doc_id']}" for c in extra], name
    assert corpus_pipeline.STAGES[-1][1](spark, df, DATA).count() == len(rows)


def plain_mix(spark, rows, seed=20_240_501):
    """How often each doc_id is taken: words laid out one by one in seeded order, blocks counted off."""
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t, _ in rows}
    sizes = Counter()
    for i, _, source in rows:
        sizes[source] += size[i]
    assert max(sizes.values()) < 1 << 20  # one shard for each source
    target = plain_targets(sizes)
    block = max(1, min(1024, int(min(t for t in target.values() if t > 0) / 256)))
    order = {r["i"]: r["h"] for r in spark.createDataFrame([(i,) for i in size], "i bigint").selectExpr("i", f"xxhash64(i, {seed + 2}) AS h").collect()}
    first = {r["s"]: r["h"] for r in spark.createDataFrame([(s,) for s in sizes], "s string").selectExpr("s", f"xxhash64(s, 0L, {seed + 1}) AS h").collect()}
    seats = plain_lague({s: target[s] for s in sorted(sizes)}, int(sum(target.values()) / block + 0.5))
    taken = Counter()
    for s in sizes:
        words = [i for _, i in sorted((order[i], i) for i, _, source in rows if source == s) for _ in range(size[i])]
        blocks = max(1, -(-len(words) // block))
        for k in range(min(seats[s], 2 * blocks)):
            at = (first[s] % blocks + k) % blocks
            taken.update(words[at * block : (at + 1) * block])
    return {i: int(taken[i] / size[i] + 0.5) if size[i] else 0 for i in size}


def test_whole_run_equals_a_plain_version(spark, docs):
    from sentencepiece import SentencePieceProcessor

    from meshlake.llm.langid import fit
    from meshlake.llm.spm import default_model

    model = fit(docs)
    rows = [(r["doc_id"], r["text"] or "", r["source"]) for r in docs.collect() if not model.predict([r["text"]])[2][0]]
    first = {}
    for i, t, s in sorted(rows):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t), (i, t, s))
    rows = list(first.values())
    least = plain_groups([(i, t) for i, t, _ in rows])
    rows = [r for r in rows if least[r[0]] == r[0]]
    times = plain_mix(spark, rows)
    library, expected = SentencePieceProcessor(model_file=default_model()), Counter()
    for i, t, _ in rows:
        ids_ = library.encode(t, add_eos=True)
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids_)), library.decode(ids_))]
        if times[i]:
            expected[(i, len(ids_), *sha)] += times[i]
    found = corpus_pipeline.run(spark, DATA).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert Counter(tuple(r) for r in found) == expected and len(expected) > 50
