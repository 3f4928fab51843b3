"""The training-data operators on small tables: against plain versions, and on odd input."""

import base64
import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = "Le mot été. " * 20_000
#: Nulls, empty and very long texts, ties, repeated rows.
ODD = [
    (5, "a  b\tc", "en", "s", 6), (3, "a b c", "en", "s", 5), (3, "a b c", "en", "s", 5), (9, None, None, None, None), (8, "", "en", None, 0),
    (None, "a b c", "fr", "s", 5), (7, LONG, "fr", "t", len(LONG)), (6, LONG + " ", "fr", "t", 1), (2, "☃😀 ▁ x\x00y", "de", "u", 1), (1, " \n\t ", "en", "s", 4),
]


@pytest.fixture(scope="module")
def odd(spark):
    """With extra columns whose names operators use inside."""
    extra = {c: F.lit("x") for c in ("uid", "pos", "block", "name", "sha", "fp", "words", "size", "taken", "shard", "variant", "key", "seats", "quota", "root", "s", "h")}
    return spark.createDataFrame(ODD, DOCS).withColumns(extra).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet").cache()


def texts_of(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


# --- chat ----------------------------------------------------------------------


def chat(spark, rows):
    from meshlake.llm.chat import format_chats, read_chats

    made = format_chats(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, parts string")).cache()
    return {r["conv_id"]: r for r in made.collect()}, {r["conv_id"]: r for r in read_chats(made).collect()}


def test_chat_round_trip_of_hostile_texts(spark):
    rng = random.Random(1)
    pieces = ["<|im_start|>", "<|im_end|>\n", "<|im_sep|>", "<|im_turn|>", "<", "|", "<|", "<||", "\n", "a", "é😀", "\\", "|>", "assistant"]
    rows = []
    for conv in range(150):
        for turn in range(rng.randint(1, 8)):
            role = rng.choice(["user", "assistant", "assistant", "system", "a<|b\n"])
            rows.append((conv, turn, role, "".join(rng.choice(pieces) for _ in range(rng.randint(0, 8))), "x"))
    made, back = chat(spark, rows)
    for conv in range(150):
        own = [r for r in rows if r[0] == conv]
        assert [(t["role"], t["text"]) for t in back[conv]["turns"]] == [(r[2], r[3]) for r in own]
        assert list(back[conv]["loss_texts"]) == [r[3] for r in own if r[2] == "assistant"]
        merges = 1 + sum(a[2] != b[2] for a, b in zip(own, own[1:], strict=False))
        assert made[conv]["formatted"].count("<|im_start|>") == merges


def test_chat_odd_rows(spark):
    made, back = chat(spark, [(1, None, None, None, ""), (1, 2, "user", "b", ""), (1, 2, "user", "a", ""), (1, 2, "user", "a", ""), (None, 1, "assistant", LONG, "")])
    assert [(t["role"], t["text"]) for t in back[1]["turns"]] == [("", ""), ("user", "a"), ("user", "a"), ("user", "b")]
    assert list(back[None]["loss_texts"]) == [LONG]
    assert made[None]["loss_spans"][0]["stop"] - made[None]["loss_spans"][0]["start"] == len(LONG)
    assert chat(spark, []) == ({}, {})


# --- SentencePiece -----------------------------------------------------------------


@pytest.fixture(scope="module")
def codec():
    from meshlake.llm import spm

    return spm.Codec(spm.load_model(spm.default_model()))


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    from meshlake.llm.spm import default_model

    return sentencepiece.SentencePieceProcessor(model_file=default_model())


def same(codec, library, text):
    ids = np.frombuffer(codec.encode(text), np.int32).tolist()
    assert ids == library.encode(text, add_eos=True), text[:80]
    assert codec.decode(ids) == library.decode(ids)


def test_encoding_equals_the_library(codec, library, docs):
    rng = random.Random(2)
    letters = " ▁\n\tabcdefghijklmnopqrstuvwxyzABCDEéèßüñ中文日本語.,;:!?()[]{}<>/\\|#*=-_+0123456789☃😀 ​"
    for k in range(3000):
        same(codec, library, "".join(rng.choice(letters if k % 2 else "ethinoas  r") for _ in range(rng.randint(0, 50))))
    for n in range(1, 50):
        for c in " -=aé▁":
            same(codec, library, c * n + "x" * (n % 2))
    for k in range(500):
        same(codec, library, "".join(codec.vocab.pieces[rng.choice(codec.vocab.usable)].replace("▁", " ") for _ in range(20)))
    for _, text in texts_of(docs):
        same(codec, library, text)


def test_encoding_with_full_generations(codec, library, docs, monkeypatch):
    from meshlake.llm import spm

    monkeypatch.setattr(spm, "MAX_SEGMENTS", 7)
    monkeypatch.setattr(spm, "MAX_PAIRS", 5)
    fresh = spm.Codec(codec.vocab)
    for _, text in texts_of(docs)[:40]:
        same(fresh, library, text)
        assert len(fresh.remembered) <= 7 and len(fresh.remembered.older) <= 7 and len(fresh.pairs) <= 5


def test_decoding_any_ids_equals_the_library(codec, library):
    rng = random.Random(3)
    for _ in range(1500):
        ids = [rng.randrange(0, 600) if rng.random() < 0.7 else rng.randrange(32000) for _ in range(rng.randint(0, 12))]
        assert codec.decode(ids) == library.decode(ids)


def test_encoding_a_table(spark, odd, none, library):
    from meshlake.llm.spm import encode_decode

    found = encode_decode(odd).collect()
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in found) == Counter((i, tuple(library.encode(t, add_eos=True))) for i, t in texts_of(odd))
    assert encode_decode(none).count() == 0


# --- personal data -----------------------------------------------------------------

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    from meshlake.llm.pii import in_order, luhn

    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and luhn(digits)):
                continue
            out.append((m.start(), m.end(), kind))
    return in_order(out)


def test_base_spans_equal_the_patterns(docs):
    from meshlake.llm.pii import base_spans

    rng = random.Random(4)
    for _ in range(10_000):
        text = "".join(rng.choice("0123456789..@@-+ ()ab%_é") for _ in range(rng.randint(0, 40)))
        assert base_spans(text) == plain_spans(text), text
    for _, text in texts_of(docs):
        assert base_spans(text) == plain_spans(text)
    assert base_spans("1" * 100_000 + "a" * 100_000 + "@") == []


def test_field_learns_and_decodes_exactly():
    from meshlake.llm import pii

    field = pii.train()
    fresh = pii.labelled_table(seed=77, rows=500)
    runs = [pii.features(b, w, a) for b, w, _, a in fresh]
    found = field.decode(runs)
    assert sum(x == y for x, (_, _, y, _) in zip(found, fresh, strict=True)) >= 0.97 * len(fresh)
    for run, labels in list(zip(runs, found, strict=True))[:60]:
        if len(run) > 3:
            continue
        score = field.emit[field.rows(run)].sum(axis=1)

        def total(path, score=score):
            return sum(score[k, y] for k, y in enumerate(path)) + sum(field.move[a, b] for a, b in zip((0, *path), (*path, 0), strict=True))

        best = max(np.ndindex(*[len(pii.LABELS)] * len(run)), key=total)
        assert total(best) == pytest.approx(total(labels))


def test_field_adds_what_patterns_miss(spark, odd, none):
    from meshlake.llm.pii import find_personal_data

    text = "call (555) 123-4567 today, or +1 (826) 555-4081 190.137.2.8 then; in 1999 we paid 300 of 12.5"
    rows = spark.createDataFrame([(1, text), (2, "plain words of no interest 12 and 7")], "doc_id bigint, text string")
    found = {r["doc_id"]: r for r in find_personal_data(rows).collect()}
    assert [text[s["start"] : s["stop"]] for s in found[1]["added"]] == ["(555) 123-4567", "+1 (826) 555-4081"]
    assert not found[2]["added"] and not found[2]["base"]
    assert find_personal_data(odd).count() == len(ODD) and find_personal_data(none).count() == 0


# --- exact deduplication -----------------------------------------------------------


def plain_dedup(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", text)].append(doc_id)
    out = Counter()
    for norm, ids in groups.items():
        known = [i for i in ids if i is not None]
        first = min(known) if known else None
        sha = hashlib.sha256(norm.encode()).hexdigest()
        kept = False
        for i in ids:
            out[i, first, len(ids), i == first and not kept, sha] += 1
            kept = kept or i == first
    return out


@pytest.mark.parametrize("block", [1, 3, 4096])
def test_exact_dedup(spark, odd, none, block):
    from meshlake.llm.exact import exact_dedup

    rng = random.Random(5)
    rows = [(k, "".join(rng.choice("ab \n") for _ in range(rng.randint(0, 9)))) for k in range(300)]
    for df in (spark.createDataFrame(rows, "doc_id bigint, text string"), odd.where("doc_id <> 7 AND doc_id <> 6 OR doc_id IS NULL") if block < 9 else odd):
        found = exact_dedup(df, block).collect()
        assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in found) == plain_dedup(texts_of(df))
    assert exact_dedup(none, block).count() == 0


# --- mixing ------------------------------------------------------------------------


def plain_lague(votes, seats):
    """Seats one by one to the highest quotient."""
    won = dict.fromkeys(votes, 0)
    for _ in range(seats if any(votes.values()) else 0):
        won[min(votes, key=lambda s: (-votes[s] / (2 * won[s] + 1), s))] += 1
    return won


def test_sainte_lague(spark):
    from meshlake.llm.mixing import sainte_lague

    rng = random.Random(6)
    for _ in range(4):
        rows = [(g, s, float(rng.choice([0, 1, 5, 5, rng.randint(1, 1000)])), 7 * g) for g in range(1, 6) for s in range(rng.randint(1, 9))]
        found = sainte_lague(spark.createDataFrame(rows, "g bigint, s bigint, votes double, seats bigint"), "s", "votes", "seats", ["g"]).collect()
        for g in range(1, 6):
            votes = {s: v for x, s, v, _ in rows if x == g}
            assert {r["s"]: r["quota"] for r in found if r["g"] == g} == plain_lague(votes, 7 * g)


def plain_targets(sizes):
    """Shared by weight; what is above twice the size is shared again."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, left = {}, 1.5 * sum(sizes.values())
    open_ = set(order)
    while open_:
        unit = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * unit > 2 * sizes[s]}
        if not full:
            return target | {s: weight[s] * unit for s in open_}
        for s in full:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= full
    return target


def test_mix(spark, docs, odd, none):
    from meshlake.llm.mixing import mix

    for df, near in ((docs, 0.01), (odd, None)):
        found = mix(df, shard_words=3000).collect()
        sizes = Counter()
        for r in df.select("text", "source").collect():
            sizes[r["source"]] += len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
        target, taken = plain_targets(sizes), Counter()
        for r in found:
            assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(target[r["source"]])
            assert 0 <= r["taken"] <= 2 * r["size"]
            taken[r["source"]] += r["taken"]
        assert len(found) == df.count()
        for s in target if near else ():
            assert abs(taken[s] - target[s]) <= near * target[s]
    again = mix(docs, shard_words=3000).select("doc_id", "taken")
    assert again.exceptAll(mix(docs.repartition(5), shard_words=3000).select("doc_id", "taken")).count() == 0
    assert mix(none).count() == 0


# --- licences ----------------------------------------------------------------------


def plain_scan(text, rules=None):
    """Word by word flags of what is taken; each rule is looked for in the words that are still free."""
    from meshlake.llm.license_rules import BASE, RULES

    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    base = [(k, k + len(phrase.split()), label) for phrase, label in BASE for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
    free, found = [True] * len(words), []
    for r in rules or RULES:
        line = "".join(f" {w if f else chr(1)}" for w, f in zip(words, free, strict=True)) + " "  # gaps in rules don't reach across this
        for m in re.finditer(f" (?:{r.pattern})(?= )", line):
            start = line[: m.start()].count(" ")
            stop = start + m[0].count(" ")
            free[start:stop] = [False] * (stop - start)
            found.append((start, stop, r.priority, r.label))
    return len(words), sorted(base), sorted(found)


def test_gaps_in_rules_dont_reach_across_better_ones(spark):
    """Whatever signatures are mixed, intervals don't overlap and cover no more than all words."""
    from meshlake.llm.license_rules import RULES
    from meshlake.llm.licenses import license_scan

    rng = random.Random(11)
    texts = [
        "By installing the Apache Software License 2.0 you agree to be bound by the terms of this agreement",
        "neither the name of MIT no attribution nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        "this ebook is for the use of anyone anywhere at no cost and with almost no restrictions whatsoever under the mit license project gutenberg",
    ]
    simple = [r.pattern for r in RULES if not re.search(r"[][(){}?|\\*+.]", r.pattern)]
    gaps = [("by installing", "you agree to be bound by the terms of this eula"), ("neither the name of", "nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"), ("this ebook is for the use of anyone anywhere at no cost and with almost no restrictions whatsoever", "project gutenberg")]
    for _ in range(300):
        parts = [rng.choice([*simple, "some words", "é", "the"]) for _ in range(rng.randint(1, 5))]
        first, last = rng.choice(gaps)
        texts.append(" ".join(rng.choice([[first, *parts, last], [first, *parts, first, last], [*parts, first, last]])))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert scanned(df) == Counter((i, str(plain_scan(t))) for i, t in enumerate(texts))
    rows = {r["doc_id"]: r for r in license_scan(df).collect()}
    assert [(x["start"], x["stop"], x["label"]) for x in rows[0]["detections"]] == [(3, 8, "apache-2.0")]
    for r in rows.values():
        spans = sorted((x["start"], x["stop"]) for x in r["detections"])
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False)) and sum(b - a for a, b in spans) <= r["n_words"]


def scanned(df, *rules):
    from meshlake.llm.licenses import license_scan

    rows = license_scan(df, *rules).collect()
    return Counter((r["doc_id"], str((r["n_words"], sorted((b["start"], b["stop"], b["label"]) for b in r["base"]), [tuple(x) for x in r["detections"]]))) for r in rows)


def test_license_scan(spark, docs, odd, none):
    from meshlake.llm.licenses import license_scan

    lines = [
        "Licensed under the Apache License, Version 2.0.", "CC BY-NC 4.0 cc by cc by", "GNU General Public License, version 3 or later", "all rights reserved. ALL RIGHTS RESERVED",
        "Released under the MIT License. Copyright (c) 2021", "lGPLv2.1 and GPL-3.0-only", "cc-by--sa 2.5", "éALL rights reservedé", "cc by", "public domain", "\u212a mit license",
    ]
    own = spark.createDataFrame([(k, t) for k, t in enumerate(lines)], "doc_id bigint, text string")
    for df in (own, docs, odd):
        assert scanned(df) == Counter((i, str(plain_scan(t))) for i, t in texts_of(df))
    labels = {r["doc_id"]: [x["label"] for x in r["detections"]] for r in license_scan(own).collect()}
    assert labels[0] == ["apache-2.0"] and labels[2] == ["gpl-3-or-later"] and labels[4] == ["mit", "copyright"]
    assert license_scan(odd).count() == len(ODD) and license_scan(none).count() == 0


def test_a_better_rule_takes_only_its_own_words(spark):
    """b overlaps both others and is worse than c: it goes, and a stays since nothing kept overlaps it."""
    from meshlake.llm.license_rules import rules_of

    rules = rules_of("c | w3 | w2 w3\nb | w2 | w1 w2\na | w0 | w0 w1\ninside | w4 | w4\nlonger | w4 | w4 w5")
    texts = ["w0 w1 w2 w3", "w0 w1 w2", "w1 w2 w1 w2 w3 w0 w1", "w4 w5 w4 w4 w5", "w3 w2", "W0 w1\x01w2\x02w3\x03 w1"]
    rng = random.Random(8)
    texts += [" ".join(rng.choice(["w0", "w1", "w2", "w3", "w4", "w5", "x"]) for _ in range(60)) for _ in range(50)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = scanned(rows, rules)
    assert found == Counter((k, str(plain_scan(t, rules))) for k, t in enumerate(texts))
    assert (0, str((4, [], [(0, 2, 2, "a"), (2, 4, 0, "c")]))) in found


def test_every_signature_finds_its_own_text(spark):
    """The shortest text of each rule has its keywords, and what takes its words is that rule or a better one."""
    from re import _constants as C
    from re import _parser

    from meshlake.llm.license_rules import RULES

    def shortest(tree):
        out = ""
        for op, value in tree:
            if op is C.LITERAL:
                out += chr(value)
            elif op is C.IN:
                out += chr(value[0][1] if value[0][0] is C.LITERAL else value[0][1][0])
            elif op is C.BRANCH:
                out += shortest(value[1][0])
            elif op is C.SUBPATTERN:
                out += shortest(value[-1])
            elif op is C.ANY:
                out += "z"
            else:
                out += shortest(value[2]) * value[0]
        return out

    texts = [" ".join(shortest(_parser.parse(r.pattern.replace(".{0,", ".{1,"))).split()) for r in RULES]
    for r, t in zip(RULES, texts, strict=True):
        assert set(r.keywords) <= set(t.split()), r
        assert re.search(f" (?:{r.pattern})(?= )", f" {t} "), r
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert scanned(rows) == Counter((k, str(plain_scan(t))) for k, t in enumerate(texts))
    own = sum(any(d[2] == r.priority for d in plain_scan(t)[2]) for r, t in zip(RULES, texts, strict=True))
    assert len(RULES) >= 400 and own >= 0.95 * len(RULES)


# --- SimHash -----------------------------------------------------------------------


def plain_fp(text):
    import xxhash

    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    if not w:
        return 0
    grams = [" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))]
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(fps)), 2):
        if (fps[a][1] ^ fps[b][1]).bit_count() <= 2:
            root[find(a)] = find(b)
    least = defaultdict(list)
    for k, (i, _) in enumerate(fps):
        least[find(k)].append(i)
    return Counter((i, fp, min((x for x in least[find(k)] if x is not None), default=None)) for k, (i, fp) in enumerate(fps))


def test_simhash(spark, docs, odd, none):
    from meshlake.llm.simhash import near_duplicates

    for df in (docs, odd):
        found = near_duplicates(df).collect()
        assert Counter((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in found) == plain_components([(i, plain_fp(t)) for i, t in texts_of(df)])
    assert near_duplicates(none).count() == 0


def test_chains_of_fingerprints(spark):
    from meshlake.llm.components import connected_components
    from meshlake.llm.simhash import links

    rng = random.Random(8)
    fps, at = {0}, 0
    for _ in range(120):  # a chain of one or two flipped bits at a time, and strangers
        at ^= sum({1 << rng.randrange(64) for _ in range(rng.randint(1, 2))})
        fps |= {at, rng.getrandbits(64)}
    rows = [(k, fp) for k, fp in enumerate(sorted(fps))]
    signed = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp bigint")
    found = {r["node"] % (1 << 64): r["root"] % (1 << 64) for r in connected_components(links(signed)).collect()}
    groups = defaultdict(set)
    for _, fp in rows:
        groups[found.get(fp, fp)].add(fp)
    expected = defaultdict(set)
    for i, fp, first in plain_components(rows):
        expected[first].add(fp)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))
    with pytest.raises(ValueError, match="even"):
        links(signed, 3)


# --- nearest neighbours --------------------------------------------------------------


def plain_nearest(rows, k=10):
    good = [(i, np.array(v, float)) for i, v in rows if v is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    out = {}
    for q, p in good:
        if q % 100 == 0:
            out[q] = [i for _, i in sorted((float(np.sqrt(((v - p) ** 2).sum())), i) for i, v in good if i != q)[:k]]
    return out


@pytest.mark.parametrize(("rows", "clusters", "most"), [(500, 0, 0.75), (2000, 0, 0.5), (2000, 20, 0.15), (20_000, 100, 0.05)])
def test_nearest(spark, rows, clusters, most):
    """Recall against brute force, at every size by the index, with the share of vectors that walks took."""
    from meshlake.llm import ann

    rng = np.random.default_rng(rows)
    v = rng.normal(size=(rows, 32)) + (3 * rng.normal(size=(clusters, 32))[rng.integers(0, clusters, rows)] if clusters else 0)
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "vec_id bigint, embedding array<double>")
    shares, real = [], ann._reach
    ann._reach = lambda *a: shares.append(real(*a)) or shares[-1]
    try:
        found = ann.search(df, F.col("vec_id") % 100 == 0).collect()
    finally:
        ann._reach = real
    hits = Counter()
    for q in range(0, rows, 100):
        far = np.sqrt(((v - v[q]) ** 2).sum(axis=1))
        far[q] = np.inf
        own = sorted((r["rank"], r["vec_id"], r["score"]) for r in found if r["query_id"] == q)
        assert [x[0] for x in own] == list(range(1, 11)) and np.allclose([far[x[1]] for x in own], [x[2] for x in own], rtol=1e-12)
        hits[len(set(np.argsort(far)[:10]) & {x[1] for x in own})] += 1
    assert sum(k * n for k, n in hits.items()) >= 0.9 * 10 * sum(hits.values())
    assert 0 < shares[0] <= most


def test_nearest_of_a_real_table(spark):
    from meshlake.llm.ann import search

    df = spark.read.parquet(f"{DATA}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    truth, found = plain_nearest(rows), defaultdict(list)
    for r in search(df, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect():
        found[r["query_id"]].append(r["vec_id"])
    assert sum(len(set(truth[q]) & set(found[q])) for q in truth) >= 0.9 * sum(map(len, truth.values()))
    # Blocks and packs of a few vectors each give the same as one of all.
    whole = {tuple(r) for r in search(df, F.col("vec_id") % 10 == 0, share=0.3).collect()}
    assert whole == {tuple(r) for r in search(df, F.col("vec_id") % 10 == 0, share=0.3, block_numbers=64 * 7, pack_numbers=64 * 3).collect()}


def test_vectors_of_one_component(spark):
    from meshlake.llm.ann import search

    df = spark.createDataFrame([(k, [float(k * k + 1)]) for k in range(30)], "vec_id bigint, embedding array<double>")
    found = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in search(df, F.col("vec_id") == 20).collect())
    truth = sorted((abs(k * k - 400), k) for k in range(30) if k != 20)[:10]
    assert found == [(20, n, k, float(d)) for n, (d, k) in enumerate(truth, 1)]


def test_nearest_odd_rows(spark):
    from meshlake.llm.ann import search

    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [1.0, None]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (8, [1.0, 2.0, 3.0]), (9, [0.0, 2.0]), (100, [0.0, 1.0]), (200, [0.0, 0.0])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id bigint, embedding array<float>, i int")
    found = search(df, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in found] == [(0, 1, 1), (0, 2, 2), (0, 3, 100), (0, 4, 9), (100, 1, 9), (100, 2, 0), (100, 3, 1), (100, 4, 2)]
    assert search(df.where("false"), F.col("vec_id") % 100 == 0).count() == 0
    assert search(df.where("vec_id = 4"), F.col("vec_id") % 100 == 0).count() == 0


def test_walk_is_in_order_of_summed_distance():
    from meshlake.llm.ann import MultiIndex

    rng = np.random.default_rng(9)
    sizes = rng.integers(0, 3, (7, 5))
    held = np.argwhere(sizes > 0)
    index = MultiIndex(rng.normal(size=(7, 3)), rng.normal(size=(5, 3)), held[:, 0], held[:, 1], sizes[sizes > 0])
    q = rng.normal(size=6)
    far = ((index.left - q[:3]) ** 2).sum(axis=1)[:, None] + ((index.right - q[3:]) ** 2).sum(axis=1)
    a, b = index.far(q[None])
    cells = [(i, j) for _, i, j in index.walk(a[0], b[0], 10**9)]
    assert sorted(cells) == sorted(map(tuple, held.tolist()))
    assert (np.diff([far[c] for c in cells]) >= -1e-9).all()
    some = [(i, j) for _, i, j in index.walk(a[0], b[0], 9)]
    assert some == cells[: len(some)] and sum(sizes[c] for c in some) >= 9 > sum(sizes[c] for c in some[:-1])
    assert not list(index.walk(a[0], b[0], 0))


# --- WARC --------------------------------------------------------------------------


def plain_pages(rows):
    groups, out = defaultdict(list), Counter()
    for page_id, html in rows:
        groups[(html or "").encode()].append(page_id)
    for payload, ids in groups.items():
        ids = sorted(ids, key=lambda i: (i is None, i))
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        for n, i in enumerate(ids):
            out[i, len(payload), digest, "revisit" if n else "response", ids[0] if n else None] += 1
    return out


def test_warc_round_trip(spark):
    from meshlake.llm.warc import archive_round_trip

    big = "é<p>\r\n\r\nWARC/1.1\r\n" * 9000
    odd = [(4, "u", "x"), (2, None, "x"), (2, "v", "x"), (9, "u\r\nv", None), (8, "u", ""), (7, "u", big), (6, "u", big + "!"), (5, "u", big), (None, "u", "lone"), (1, "u", "0\r\n\r\n")]
    for rows in (odd, [(r["page_id"], r["url"], r["html"]) for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()], []):
        df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("digest", F.lit("x"))
        found = archive_round_trip(df).collect()
        assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in found) == plain_pages([(i, h) for i, _, h in rows])


def test_min_bytes_leaves_small_payloads_alone(spark):
    from meshlake.llm.warc import archive_round_trip

    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], "page_id bigint, url string, html string")
    assert {r["page_id"]: r["record_type"] for r in archive_round_trip(df, 3).collect()} == {1: "response", 2: "response", 3: "response", 4: "revisit"}


def test_broken_framing_is_an_error():
    from meshlake.llm import warc

    for bad in (b"3\r\nabcd\r\n0\r\n\r\n", b"5\r\nabc", b"", b"zz\r\n"):
        with pytest.raises(ValueError):
            warc.unchunked(bad)
    assert warc.unchunked(warc.chunked(b"a" * 10_000) ) == b"a" * 10_000
    assert warc.unchunked(b"4;x=y\r\nabcd\r\n0\r\nTrailer: 1\r\n\r\n") == b"abcd"


def test_broken_records_are_set_aside(spark, tmp_path):
    """Beside whole ones, in the same archives; each with its reason."""
    from meshlake.llm import warc

    def record(page, payload, wrong=False):
        digest = base64.b32encode(hashlib.sha1(payload + b"!" * wrong).digest()).decode()
        return warc.records_of(page, "u", payload, len(payload), digest, None, 0)

    long = record("1", b"x" * 50_000)
    assert len(long) == 4
    good, more = record("2", b"fine"), record("3", b"y" * 40_000)
    cases = {
        "whole": (long, 0, None), "last": (long[:-1], 1, "segments"), "middle": (long[:1] + long[2:], 1, "segments"), "first": (long[1:], 1, "segments"), "twice": (long + long[1:2], 1, "segments"),
        "digest": (record("4", b"abc", True), 1, "digest"), "framing": ([record("5", b"abc")[0].replace(b"\r\n3\r\n", b"\r\n7\r\n")], 1, "cut short"),
        "noise": ([b"\x00\xff no record"], 1, "no WARC record"), "length": ([good[0].replace(b"Content-Length: ", b"Content-Length: x")], 1, "no length"),
        "target": ([b"WARC/1.1\r\nWARC-Type: revisit\r\nWARC-Record-ID: <r>\r\nContent-Length: 0\r\n\r\n"], 1, "warc-refers-to"),
        "other": ([b"WARC/1.1\r\nWARC-Type: warcinfo\r\nContent-Length: 2\r\n\r\nab"], 0, None),
    }
    for name, (bad, n, reason) in cases.items():
        path = tmp_path / name
        path.mkdir()
        (path / "a.warc").write_bytes(b"".join(r + b"\r\n\r\n" for r in [*good, *more[:2], *bad[:1]]))
        (path / "b.warc").write_bytes(b"".join(r + b"\r\n\r\n" for r in [*bad[1:], *more[2:], *record("6", b"last")]))
        for payloads in (True, False):
            rows = warc.read_archives(spark, str(path), payloads).collect()
            broken = [r for r in rows if r["kind"] == "broken"]
            assert len(broken) == n and all(reason in r["error"] for r in broken), (name, broken)
            whole = {r["record_id"].split(":")[2]: (r["payload_bytes"], bytes(r["payload"] or b"") == {"1": b"x" * 50_000, "2": b"fine", "3": b"y" * 40_000, "6": b"last"}[r["record_id"].split(":")[2]]) for r in rows if r["kind"] == "response"}
            expected = {"2": 4, "3": 40_000, "6": 4} | ({"1": 50_000} if name == "whole" else {})
            assert whole == {k: (v, payloads) for k, v in expected.items()}, name
    (tmp_path / "cut").mkdir()
    (tmp_path / "cut" / "a.warc").write_bytes(good[0] + b"\r\n\r\n" + long[0][:-9])
    kinds = Counter((r["kind"], "cut short" in (r["error"] or "")) for r in warc.read_archives(spark, str(tmp_path / "cut")).collect())
    assert kinds == {("response", False): 1, ("broken", True): 1}


def test_tables_and_archives_can_be_dropped(spark):
    from pathlib import Path

    from meshlake.llm import common
    from meshlake.llm.warc import archive_round_trip

    common.drop_tables(spark)
    found = archive_round_trip(spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab")], "page_id bigint, url string, html string"))
    assert found.count() == 2
    paths = [Path(p.removeprefix("file://").removeprefix("file:")) for p in common._tables]
    assert len(paths) >= 3 and all(p.exists() for p in paths)
    assert common.drop_tables(spark) == len(paths) and not any(p.parent.exists() for p in paths)


# --- language ----------------------------------------------------------------------


def test_language(spark, odd, none):
    from meshlake.llm.langid import fit, keep_known, predict

    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = fit(df)
    found = predict(df, model).join(df, "doc_id").where("held_out").select("lang_pred", "lang", "score").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in found) >= 0.95 * len(found)
    assert all(0 <= r["score"] <= 1 for r in found)
    assert keep_known(df, model).count() >= 0.995 * df.count()
    rows = {r["doc_id"]: r for r in predict(odd, model).collect()}
    assert rows[9]["lang_pred"] == rows[8]["lang_pred"] == rows[1]["lang_pred"] == "und" and rows[9]["score"] == 0 and rows[9]["rejected"]
    assert rows[7]["lang_pred"] in model.languages
    assert predict(none, model).count() == 0
    strange = spark.createDataFrame([(1, "中文字符测试文本" * 20)], "doc_id bigint, text string")
    assert predict(strange, model).first()["rejected"]
    assert predict(odd, fit(none)).where("lang_pred <> 'und'").count() == 0


def test_held_out_documents_are_not_learned_from(spark):
    from zlib import crc32

    from meshlake.llm.langid import fit, held_out

    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert all(r["h"] == (crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in df.select("doc_id", held_out().alias("h")).collect())
    lied = df.withColumn("lang", F.when(held_out(), F.lit("xx")).otherwise(F.col("lang")))
    assert "xx" not in fit(lied).languages
