"""Spelling variants, MinHash near-duplicates and the fill-in-middle transformation: against plain versions, and on odd input."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import combinations
from zlib import crc32

import pytest
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, source string"
LONG = "Été naïve straße wonderful wonderfull. " * 20_000
ODD = [
    (5, "wonderful\tWONDERFUL wonderfu", "s"), (3, "a b c d", "s"), (3, "a b c d", "s"), (9, None, None), (8, "", "s"), (None, "a b c d", "s"),
    (7, LONG, "t"), (6, LONG + "x", "t"), (2, "☃😀 ▁ x\x00y ß÷×àÿ", "u"), (1, " \n\t\x0b\x0c\r ", "s"), (4, "\n\none\n\ntwo", "s"), (11, "A <S> b", "s"), (12, "a b C D e", "s"), (13, "a b c d e", "s"),
]


@pytest.fixture(scope="module")
def odd(spark):
    """With extra columns whose names operators use inside."""
    extra = {c: F.lit("x") for c in ("word", "n", "gram", "place", "output", "form", "hi", "lo", "id", "first", "regions", "root", "items", "size", "made")}
    return spark.createDataFrame(ODD, DOCS).withColumns(extra).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet").cache()


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# --- spelling ------------------------------------------------------------------


def near(a, b):
    """Whether one edit turns one word into the other, by trying all."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_counts(rows, least=7):
    out = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = lower(run)
            h = crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            out[w] += 1
    return {w: n for w, n in out.items() if len(w) >= least and n >= 2}


def plain_variants(counts):
    by = defaultdict(set)
    for a, b in combinations(counts, 2):
        if near(a, b):
            by[a].add(b)
            by[b].add(a)
    form = {}
    for w, n in counts.items():
        best = min(by[w], key=lambda x: (-counts[x], x), default=None)
        if best is not None and counts[best] >= 10 * n:
            form[w] = best

    def root(w):
        return root(form[w]) if w in form else w

    return {(w, form.get(w), root(w), n, len(by[w]), counts[form[w]] if w in form else None) for w, n in counts.items()}


def test_spelling_variants(docs, odd, none):
    from meshlake.llm.spelling import spelling_variants

    for df in (docs, odd):
        found = [tuple(r) for r in spelling_variants(df).collect()]
        assert len(found) == len(set(found)) and set(found) == plain_variants(plain_counts(rows_of(df)))
    assert spelling_variants(none).count() == 0
    assert {r["word"] for r in spelling_variants(odd).collect()} >= {"wonderful", "wonderfull"}


def test_near_words_of_few_letters(spark):
    """Words in which bigrams repeat and tie: none is missed by looking under three bigrams only."""
    from meshlake.llm.spelling import near_words

    rng = random.Random(5)
    words = {"".join(rng.choice("ab" if k % 2 else "abcé") for _ in range(rng.randint(4, 9))) for k in range(900)} | {"a" * k for k in range(4, 12)}
    want = {(a, b) for a in words for b in words if near(a, b)}
    found = [tuple(r) for r in near_words(spark.createDataFrame([(w,) for w in sorted(words)], "word string")).collect()]
    assert len(found) == len(set(found)) and set(found) == want


def test_chains_of_forms(spark):
    """Each form ten times as frequent as the last; ties go to the smaller word."""
    from meshlake.llm.spelling import variants

    chain = ["aaaaaaa", "aaaaaab", "aaaaabb", "aaaabbb", "aaabbbb", "aabbbbb"]
    rows = [(w, 2 * 10**k) for k, w in enumerate(chain)] + [("zzzzzza", 500), ("zzzzzzb", 500), ("zzzzzzz", 5), ("qqqqqqq", 49), ("qqqqqqr", 5)]
    found = {r["word"]: r for r in variants(spark.createDataFrame(rows, "word string, n long")).collect()}
    assert all(found[w]["root"] == chain[-1] for w in chain) and found[chain[0]]["form"] == chain[1]
    assert found["zzzzzzz"]["form"] == "zzzzzza" and found["zzzzzzz"]["n_near"] == 2 and found["qqqqqqr"]["form"] is None
    with pytest.raises(ValueError, match="ratio"):
        variants(spark.createDataFrame(rows, "word string, n long"), ratio=1)


# --- minhash ---------------------------------------------------------------------


def shingles(text, words=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    return frozenset(" ".join(w[k : k + words]) for k in range(max(1, len(w) - words + 1))) if w else frozenset()


def plain_components(rows, similarity=85):
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j in combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]):
            up[find(j)] = find(i)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return Counter((i, len(sets[k]), (least.get(find(k)) if sets[k] else i)) for k, (i, _) in enumerate(rows))


def test_minhash(docs, odd, none):
    from meshlake.llm.forest import near_duplicates

    for df in (docs, odd):
        found = near_duplicates(df).collect()
        assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found) == plain_components(rows_of(df))
        assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found)
    assert near_duplicates(none).count() == 0


def planted(spark, rng, groups, copies, changed):
    """Random texts and near copies of each, with so many of 200 words changed; one text far from all others besides each."""
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    rows = []
    for g in range(groups):
        base = [word() for _ in range(200)]
        rows += [(1000 * g, " ".join(base)), (500_000 + g, " ".join(word() for _ in range(150)))]
        for k in range(1, copies + 1):
            own = list(base)
            for at in rng.sample(range(200), changed):
                own[at] = word()
            rows.append((1000 * g + k, " ".join(own)))
    return spark.createDataFrame(rows, "doc_id bigint, text string"), rows


def test_minhash_finds_planted_copies(spark):
    from meshlake.llm.forest import near_duplicates

    df, rows = planted(spark, random.Random(8), 150, 2, 3)
    found = {r["doc_id"]: r["component_id"] for r in near_duplicates(df).collect()}
    want = {i: c for i, _, c in plain_components(rows)}
    assert sum(found[i] != want[i] for i in want) <= 0.01 * len(want) and all(found[i] == i for i in found if i >= 500_000)


@pytest.mark.parametrize("crowd", [40, 1 << 15])
def test_minhash_of_a_large_group_around_one_text(spark, crowd):
    """Copies that are near to the one text but not to each other are found, also where regions are split for being crowded."""
    from meshlake.llm.forest import near_duplicates

    df, rows = planted(spark, random.Random(9), 1, 400, 3)
    found = {r["doc_id"]: r["component_id"] for r in near_duplicates(df, crowd=crowd).collect()}
    want = {i: c for i, _, c in plain_components(rows)}
    assert sum(c == 0 for c in want.values()) > 390
    assert sum(found[i] != want[i] for i in want) <= 0.02 * len(want)


def test_shingle_hashes_in_pieces(monkeypatch):
    from meshlake.llm import forest

    text = " ".join(str(n % 977) for n in range(5000))
    whole = forest.shingle_hashes(text, 5)
    monkeypatch.setattr(forest, "_PIECE", 64)
    assert (forest.shingle_hashes(text, 5) == whole).all() and len(whole) == len(shingles(text))
    assert len(forest.shingle_hashes("", 5)) == 0 and len(forest.shingle_hashes("one two", 5)) == 1


# --- fill in the middle ------------------------------------------------------------


def plain_fim(i, text):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = [int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")):
        return "plain", n, None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 50:
        return "spm", n, len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return "psm", n, len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle(docs, odd, none):
    from meshlake.llm.fim import fill_in_middle, restored

    for df in (docs, odd):
        made = restored(fill_in_middle(df)).collect()
        assert Counter((r["doc_id"], r["form"], r["n"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in made) == Counter((i, *plain_fim(i, t)) for i, t in rows_of(df))
        assert Counter((r["doc_id"], r["text"]) for r in made) == Counter((i, t or "") for i, t in rows_of(df))
    assert fill_in_middle(none).count() == 0
    rates = Counter(r["form"] for r in fill_in_middle(docs, fim_rate=50).collect())
    assert 0.3 * docs.count() < rates["plain"] < 0.7 * docs.count() and rates["spm"] and rates["psm"]
    assert {r["form"] for r in fill_in_middle(docs, spm_rate=0).collect()} == {"psm"}


def test_markers_that_could_arise_by_chance_are_refused():
    from meshlake.llm.fim import PSM, Markers, restore

    for bad in (("<P>", "<P>", "<M>"), ("", "<S>", "<M>"), ("<<P", "<S>", "<M>"), ("<a>", "b<", "<M>")):
        with pytest.raises(ValueError, match="markers"):
            Markers(*bad)
    with pytest.raises(ValueError, match="form"):
        restore("<P>a<M>b", PSM)
    with pytest.raises(ValueError, match="form"):
        restore("a", "other")
    assert restore("<P>a<<S>>b<M>c", PSM) == "a<c>b"
