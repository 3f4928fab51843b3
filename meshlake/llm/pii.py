"""Personal data: fixed patterns, and a linear-chain conditional random field.

The patterns always count. The field adds what they miss (phone numbers without
a country code, numbers in unusual groups, addresses with other letters, secrets
such as tokens and keys): it labels words by their shape and their neighbours, is
trained from a small labelled table made by rule, and is decoded by Viterbi in
numpy batches. What it labels is only reported if it also has the form of its
kind: a card's number passes Luhn, a telephone number has 7 to 15 digits.

Only words with a digit or ``@`` can get a label; all others are O by definition
of the model. The chain therefore splits at them without loss: decoding each
run of such words, with O before and after, is the decoding of the whole text.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from meshlake.llm.common import small_batches, text_of

#: What the patterns find, and what the field finds besides; spans that start together stand in this order.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")
#: Label 0 is O.
LABELS = ("O", *KINDS)

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_HOT = re.compile(r"[0-9@]")
_SPACES = re.compile(r"[\x20\x09-\x0D]")
_GAP = "\x20\x09\x0a\x0b\x0c\x0d"
_NOT_DIGIT = re.compile(r"[^0-9]")
_ALNUM = re.compile(r"[^\W_]")
_HEX = re.compile(r"[0-9a-fA-F]+")
_UUID = re.compile(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}")
_CODE = re.compile(r"[A-Za-z0-9_+/-]+=*")
#: The forms that added spans must have.
_ADDRESS = re.compile(r"[^@]+@[^@.]+(?:\.[^@.]+)+")
_QUAD = re.compile(r"([0-9]{1,3})\.([0-9]{1,3})\.([0-9]{1,3})\.([0-9]{1,3})(?::[0-9]{1,5})?")
_CARD_FORM = re.compile(r"[0-9][0-9\x20./_-]*")
_PHONE_FORM = re.compile(r"[+(]?[0-9][0-9\x20()./+-]*")

Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2])
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def base_spans(text: str) -> list[Span]:
    """``start, end, kind`` of the fixed patterns: leftmost, non-overlapping per kind, in linear time."""
    out: list[Span] = []
    if not _HOT.search(text):
        return out
    at, last = text.find("@"), 0
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end(), "email"))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p or "0") <= 255 for p in (x.lstrip("0") for x in m[0].split("."))):
            out.append((m.start(), m.end(), "ip"))
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), m.end(), "card"))
    for m in _PHONE.finditer(text):
        if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
            out.append((m.start(), m.end(), "phone"))
    return in_order(out)


def in_order(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def hot_runs(text: str) -> Iterator[tuple[str, list[tuple[int, int]], str]]:
    """Runs of neighbouring words with a digit or ``@``: the word before, their places, the word after.

    Words without a letter or digit, such as ``=``, don't count as the word before or after.
    Between two runs there is always another word, so each gap is looked at once from either side.
    """

    def word_at(place: int) -> tuple[int, int]:
        start = place
        while start > 0 and text[start - 1] not in _GAP:
            start -= 1
        end = _SPACES.search(text, place)
        return start, end.start() if end else len(text)

    def before(place: int, floor: int) -> str:
        while place > floor:
            stop = place
            while stop > floor and text[stop - 1] in _GAP:
                stop -= 1
            start = stop
            while start > floor and text[start - 1] not in _GAP:
                start -= 1
            if _ALNUM.search(text, start, stop):
                return text[start:stop]
            place = start
        return ""

    def after(place: int) -> str:
        hit = _ALNUM.search(text, place)
        return text[slice(*word_at(hit.start()))] if hit else ""

    hit, floor = _HOT.search(text), 0
    while hit:
        places = [word_at(hit.start())]
        while True:
            hit = _HOT.search(text, places[-1][1])
            if not hit:
                break
            nxt = word_at(hit.start())
            if text[places[-1][1] : nxt[0]].strip(_GAP):
                break
            places.append(nxt)
        yield before(places[0][0], floor), places, after(places[-1][1])
        floor = places[-1][1]


_PUNCT = ".,;:!?\"'()[]{}<>*#$%&|=`~"
_CUES = {
    "phone": "phone", "tel": "phone", "telephone": "phone", "call": "phone", "mobile": "phone", "cell": "phone", "fax": "phone", "telefon": "phone",
    "téléphone": "phone", "teléfono": "phone", "email": "email", "mail": "email", "e-mail": "email", "contact": "email", "ip": "ip", "host": "ip",
    "server": "ip", "address": "ip", "card": "card", "visa": "card", "mastercard": "card", "amex": "card", "credit": "card", "carte": "card",
    "karte": "card", "tarjeta": "card", "version": "number", "v": "number", "page": "number", "order": "number", "in": "number",
    "token": "secret", "key": "secret", "secret": "secret", "password": "secret", "passwd": "secret", "api_key": "secret", "apikey": "secret",
    "access_token": "secret", "auth_token": "secret", "client_secret": "secret", "secret_key": "secret", "bearer": "secret",
    "commit": "digest", "sha": "digest", "sha1": "digest", "sha256": "digest", "md5": "digest", "checksum": "digest", "hash": "digest", "digest": "digest", "revision": "digest", "uuid": "digest",
}


def _shape(word: str) -> str:
    return _short_shape(word) if len(word) <= 64 else _shape_of(word)


@lru_cache(maxsize=1 << 16)
def _short_shape(word: str) -> str:
    return _shape_of(word)


def _shape_of(word: str) -> str:
    """Character classes with runs shortened: (017) is (ddd), longer runs of digits tell their length."""
    out = []
    for run in re.finditer(r"[0-9]+|[A-Z]+|[^\W\d_A-Z]+|.", word, re.S):
        r = run[0]
        out.append("d" * len(r) if r[0].isdigit() and len(r) <= 4 else "D" if r[0].isdigit() else "A" if r.isupper() and r.isalpha() else "a" if r.isalpha() else r)
    return "".join(out)


def _cue(word: str) -> str:
    return _CUES.get(word.strip(_PUNCT).lower(), "other")


def _code(core: str) -> str:
    """Whether a word looks like a key: long, of both letters and digits."""
    name, _, value = core.rpartition("=")
    value = value.strip(_PUNCT)
    if len(value) < 16 or not _CODE.fullmatch(value) or value.isdigit() or not re.search("[0-9]", value):
        return "none"
    kind = "hex" if _HEX.fullmatch(value) else "uuid" if _UUID.fullmatch(value) else "mixed"
    named = _cue(re.split(r"[^A-Za-z_]", name.strip(_PUNCT))[-1]) if name else "none"
    return f"{kind}/{min(len(value) // 8, 8)}/{named}"


def features(before: str, words: list[str], after: str) -> list[list[str]]:
    """What the field sees of each word of a run."""
    cores = [w.strip(_PUNCT) for w in words]
    shapes = [_shape(w.strip(_PUNCT.replace("(", "").replace(")", ""))) for w in words]
    digits = [_NOT_DIGIT.sub("", w) for w in words]
    total = "".join(digits)
    cue = _cue(before)
    follows = _cue(after)
    out = []
    for k, core in enumerate(cores):
        n = len(digits[k])
        parts = core.split(".") if len(core) <= 64 else []
        whole, code = "none", _code(core)
        if core.count("@") == 1 and re.fullmatch(r"[^@]+@[^@.]+(?:\.[^@.]+)+", core):
            whole = "address"
        elif len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts):
            whole = "quad"
        elif 14 <= n <= 19 and re.fullmatch(r"[0-9][0-9./_-]*", core) and luhn(digits[k]):
            whole = "luhn"
        elif 14 <= len(total) <= 19 and luhn(total) and all(re.fullmatch(r"[0-9]+", c) for c in cores):
            whole = "luhn-run"
        f = [
            "bias", f"shape={shapes[k]}", f"n={min(n, 20)}", f"total={min(len(total), 20)}", f"whole={whole}", f"cue={cue}",
            f"before={shapes[k - 1] if k else 'O'}", f"after={shapes[k + 1] if k + 1 < len(words) else 'O'}",
            f"first={core[:1] if core[:1] in '+@#$€£' else 'x'}", f"code={code}", f"code-cue={code != 'none'}/{cue}",
            f"place={k}/{min(len(words), 4)}", f"open={words[k][:1] == '('}", f"next={follows if k + 1 == len(words) else 'in'}",
        ]
        out.append(f)
    return out


@dataclass(frozen=True)
class Field:
    """Weights of features and transitions: a few thousand numbers, whatever the corpus."""

    index: dict[str, int]
    emit: np.ndarray  # features + 1 rows, the last of zeros
    move: np.ndarray  # from, to

    def rows(self, seen: list[list[str]]) -> np.ndarray:
        none = len(self.index)
        return np.array([[self.index.get(f, none) for f in word] for word in seen], dtype=np.int64)

    def decode(self, runs: list[list[list[str]]]) -> list[list[int]]:
        """The best labels of each run by Viterbi, runs of a length together."""
        out: list[list[int]] = [[] for _ in runs]
        by_length: dict[int, list[int]] = {}
        for k, run in enumerate(runs):
            by_length.setdefault(len(run), []).append(k)
        for n, all_of in by_length.items():
            step = max(1, 65536 // n)
            for at in range(0, len(all_of), step):
                these = all_of[at : at + step]
                score = np.stack([self.emit[self.rows(runs[k])].sum(axis=1) for k in these])
                best, back = self.move[0] + score[:, 0], []
                for t in range(1, n):
                    paths = best[:, :, None] + self.move
                    back.append(paths.argmax(axis=1))
                    best = paths.max(axis=1) + score[:, t]
                label = (best + self.move[:, 0]).argmax(axis=1)
                path = [label]
                for b in reversed(back):
                    path.append(b[np.arange(len(these)), path[-1]])
                for k, labels in zip(these, np.stack(path[::-1], axis=1), strict=True):
                    out[k] = labels.tolist()
        return out


def labelled_table(seed: int = 5, rows: int = 1500) -> list[tuple[str, list[str], list[int], str]]:
    """The training table: word before, words, their labels, word after. Made by rule from forms of personal data and of other numbers."""
    rng = np.random.default_rng(seed)

    def num(n: int) -> str:
        return "".join(map(str, rng.integers(0, 10, n)))

    def word() -> str:
        return "".join(rng.choice(list("etaoinshrdluñéü"), int(rng.integers(2, 9))))

    def card(good: bool) -> str:
        body = num(int(rng.choice([13, 14, 15, 15, 15, 18])))
        return next(body + str(d) for d in rng.permutation(10) if luhn(body + str(d)) == good)

    def pick(*forms: str) -> str:
        return forms[int(rng.integers(len(forms)))]

    def ip() -> str:
        return ".".join(str(x) for x in rng.integers(0, 256, 4))

    def phone() -> str:
        a, b, c = num(3), num(3), num(4)
        return pick(
            f"+{num(1)} ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+{num(2)} {a} {b} {c}", f"+{num(1)}-{a}-{b}-{c}", f"{a}.{b}.{c}", f"({a}){b}-{c}",
            f"({a}) {b} {c}", f"00{num(2)} {a} {b}{num(2)}", f"0{num(2)}/{b}{c}", f"{num(1)}-{a}-{b}-{c}", f"0{num(1)} {num(2)} {num(2)} {num(2)} {num(2)}",
        )

    def code(letters: str, n: int) -> str:
        return "".join(rng.choice(list(letters), n - 2)) + num(1) + str(rng.choice(list("abcdef")))

    hexes, mixed = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"

    def key() -> str:
        size = int(rng.choice([32, 40, 40, 64]))
        own = pick(code(hexes, size), code(hexes, size), code(hexes, size).upper(), f"sk-{code(mixed, 40)}", f"ghp_{code(mixed, 36)}", f"AKIA{code(mixed, 16).upper()}", code(mixed, 24), code(mixed, 32))
        return pick(f'"{own}"', f'"{own}"', f"'{own}'", own)

    def grouped(c: str, by: str) -> str:
        return by.join(c[k : k + 4] for k in range(0, len(c), 4))

    def other() -> str:
        y, m, d = int(rng.integers(1900, 2100)), int(rng.integers(1, 13)), int(rng.integers(1, 29))
        return pick(
            num(1), num(2), num(3), num(4), num(5), num(6), num(7), num(9), num(12), card(False), f"{y}-{m:02}-{d:02}", f"{d}.{m}.{y}", f"{d}/{m}/{y}", f"{d}:{num(2)}", f"${num(2)}.{num(2)}",
            f"{num(1)}.{num(1)}", f"v{num(1)}.{num(1)}.{num(1)}", f"{num(2)}%", f"{num(2)}-{num(2)}", f"{num(1)},{num(3)}", f"#{num(4)}", f"@{word()}", f"{word()}{num(2)}", f"{num(3)} {num(3)}", f"{y} {num(2)}",
            f'"{code(hexes, 40)}"', code(hexes, int(rng.choice([32, 40, 64]))), f"{code(hexes, 8)}-{code(hexes, 4)}-{code(hexes, 4)}-{code(hexes, 4)}-{code(hexes, 12)}", f"{num(1)}. {num(1)}.", f"{num(3)}-{num(4)}", f"{num(2)} {num(2)} {num(2)}", f"{300 + int(num(2))}.{num(2)}.{num(3)}.{num(1)}", f"{num(1)}.{num(1)}.{num(1)}",
        )

    cues: dict[str, list[str]] = {}
    for w, k in _CUES.items():
        cues.setdefault(k, []).append(w)
    out = []
    for _ in range(rows):
        kind, named = int(rng.choice([0, 0, 0, 0, 1, 2, 3, 4, 4, 5, 5])), None
        if kind == 1:
            text = pick(f"{word()}@{word()}.com", f"{word()}.{num(2)}@{word()}{num(1)}.example.com", f"{word()}_{word()}@{word()}.{word()}.org", f"{word()}@{word()}é.net")
        elif kind == 2:
            text = pick(ip(), ip() + ":" + num(2))
        elif kind == 3:
            c = card(True)
            text = pick(c, c, grouped(c, " "), grouped(c, "-"), grouped(c, "."))
        elif kind == 5:  # told from a digest by its name, before it or in the same word
            text, named = key(), str(rng.choice(cues["secret"]))
            if rng.random() < 0.2:
                text, named = f"{named}={text}", None
        else:
            text = phone() if kind == 4 else other()
            if not kind and re.search("[0-9a-f]{30}", text):
                named = str(rng.choice([*cues["digest"], word()]))
        words = text.split()
        if kind and rng.random() < 0.15:  # next to another number
            more = other().split()
            labels = [kind] * len(words) + [0] * len(more)
            words += more
        else:
            labels = [kind] * len(words)
        if rng.random() < 0.3:
            words[-1] += pick(".", ",", "!!", "###", ")", "%%%", "$$$")
        own = cues[LABELS[kind]] if kind else cues["number"]
        before = named or (str(rng.choice(own)) if rng.random() < 0.3 else word())
        out.append((before, words, labels, word()))
    return out


def train(table: list[tuple[str, list[str], list[int], str]] | None = None, steps: int = 150, decay: float = 0.02) -> Field:
    """Maximum likelihood with L2 decay: forward-backward over runs of a length together, Adam steps."""
    table = labelled_table() if table is None else table
    seen = [features(b, w, a) for b, w, _, a in table]
    index = {f: k for k, f in enumerate(sorted({f for run in seen for word in run for f in word}))}
    n_labels = len(LABELS)
    emit, move = np.zeros((len(index) + 1, n_labels)), np.zeros((n_labels, n_labels))
    field = Field(index, emit, move)
    groups: dict[int, tuple[list, list]] = {}
    for run, (_, _, labels, _) in zip(seen, table, strict=True):
        own = groups.setdefault(len(run), ([], []))
        own[0].append(field.rows(run))
        own[1].append(labels)
    batches = [(np.stack(x), np.array(y)) for x, y in groups.values()]

    def total(x: np.ndarray, axis: int) -> np.ndarray:
        top = x.max(axis=axis, keepdims=True)
        return np.log(np.exp(x - top).sum(axis=axis)) + np.squeeze(top, axis)

    moments = [np.zeros_like(emit), np.zeros_like(move), np.zeros_like(emit), np.zeros_like(move)]
    for step in range(1, steps + 1):
        d_emit, d_move = -decay * emit, -decay * move
        for x, y in batches:
            n, t = y.shape
            score = emit[x].sum(axis=2)
            fore, back = [move[0] + score[:, 0]], [np.tile(move[:, 0], (n, 1))]
            for k in range(1, t):
                fore.append(total(fore[-1][:, :, None] + move, 1) + score[:, k])
            for k in range(t - 1, 0, -1):
                back.append(total(move + (back[-1] + score[:, k])[:, None, :], 2))
            back.reverse()
            z = total(fore[-1] + move[:, 0], 1)
            for k in range(t):
                own = -np.exp(fore[k] + back[k] - z[:, None])
                own[np.arange(n), y[:, k]] += 1
                np.add.at(d_emit, x[:, k], own[:, None, :])
                if k == 0:
                    d_move[0] += own.sum(axis=0)
                if k == t - 1:
                    d_move[:, 0] += own.sum(axis=0)
                if k:
                    pair = np.exp(fore[k - 1][:, :, None] + move + (score[:, k] + back[k])[:, None, :] - z[:, None, None])
                    d_move -= pair.sum(axis=0)
                    np.add.at(d_move, (y[:, k - 1], y[:, k]), 1)
        d_emit[-1] = 0
        for value, slope, first, second in ((emit, d_emit, moments[0], moments[2]), (move, d_move, moments[1], moments[3])):
            first *= 0.9
            first += 0.1 * slope
            second *= 0.99
            second += 0.01 * slope * slope
            value += 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return field


def has_form(kind: str, own: str) -> bool:
    """Whether a stretch of text has the form that an added span of a kind must have."""
    n = len(_NOT_DIGIT.sub("", own))
    if kind == "card":
        return 14 <= n <= 19 and bool(_CARD_FORM.fullmatch(own)) and luhn(_NOT_DIGIT.sub("", own))
    if kind == "phone":
        return 7 <= n <= 15 and bool(_PHONE_FORM.fullmatch(own))
    if kind == "ip":
        quad = _QUAD.fullmatch(own)
        return bool(quad) and all(int(x) <= 255 for x in quad.groups())
    if kind == "email":
        return bool(_ADDRESS.fullmatch(own))
    return _code(own) != "none"


#: Digits that a stretch of several words has at most; other kinds are single words.
_MOST_DIGITS = {"card": 19, "phone": 15}


def _stretches(text: str, words: list[tuple[int, int]], kind: str) -> Iterator[tuple[int, int]]:
    """In neighbouring words with one label, from left to right: the longest stretch of whole words with the form of the kind."""
    keep = "(+" if kind == "phone" else ""
    strip = "".join(c for c in _PUNCT if c not in keep)
    at = 0
    while at < len(words):
        best, end, digits = None, at, 0
        while end < len(words):
            digits += len(_NOT_DIGIT.sub("", text[slice(*words[end])]))
            if end > at and digits > _MOST_DIGITS.get(kind, 0):
                break
            own = text[words[at][0] : words[end][1]]
            start, stop = words[at][0] + len(own) - len(own.lstrip(strip)), words[end][1] - (len(own) - len(own.rstrip(_PUNCT)))
            if start < stop and has_form(kind, text[start:stop]):
                best = end, start, stop
            end += 1
        if best:
            yield best[1], best[2]
        at = best[0] + 1 if best else at + 1


class _Taken:
    """The union of spans, for quick overlap tests."""

    def __init__(self, spans: list[Span]):
        self.starts: list[int] = []
        self.stops: list[int] = []
        for s, e, _ in sorted(spans):
            if self.stops and s < self.stops[-1]:
                self.stops[-1] = max(self.stops[-1], e)
            else:
                self.starts.append(s)
                self.stops.append(e)

    def meets(self, start: int, stop: int) -> bool:
        k = bisect_left(self.starts, stop)
        return k > 0 and self.stops[k - 1] > start


def added_spans(texts: list[str], base: list[list[Span]], field: Field) -> list[list[Span]]:
    """For each text, what the field finds outside the base spans."""
    runs, places = [], []
    taken = [_Taken(spans) for spans in base]
    for k, text in enumerate(texts):
        for before, words, after in hot_runs(text):
            if all(taken[k].meets(s, e) for s, e in words):
                continue  # all its words are in base spans already
            runs.append(features(before, [text[s:e] for s, e in words], after))
            places.append((k, words))
    out: list[list[Span]] = [[] for _ in texts]
    for (k, words), labels in zip(places, field.decode(runs), strict=True):
        at = 0
        while at < len(words):
            end = at + 1
            while end < len(words) and labels[end] == labels[at]:
                end += 1
            if labels[at]:
                kind = LABELS[labels[at]]
                for start, stop in _stretches(texts[k], words[at:end], kind):
                    if not taken[k].meets(start, stop):
                        out[k].append((start, stop, kind))
            at = end
    return out


def find_personal_data(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """One row per row of ``docs(doc_id, text, ...)``: ``doc_id, base, added``, arrays of ``start, stop, kind``.

    Places count code points, the stop is exclusive; both arrays are in order of start, then kind.
    Base spans have the kinds of ``BASE_KINDS``, added ones any of ``KINDS`` and no overlap with base ones.
    Null text counts as empty and has no spans. Repeated rows and null ids are rows like others;
    whole texts of any length are searched; an empty table gives no rows; other columns aren't read.
    """
    import pyarrow as pa

    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(field or train())
    kind = docs.schema["doc_id"].dataType.simpleString()
    span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("kind", pa.string())]))

    def packed(spans: list[list[Span]]) -> pa.Array:
        return pa.array([[{"start": s, "stop": e, "kind": k} for s, e, k in own] for own in spans], span)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            base = [base_spans(t) for t in texts]
            added = [in_order(s) for s in added_spans(texts, base, shared.value)]
            yield pa.RecordBatch.from_arrays([batch.column(0), packed(base), packed(added)], names=["doc_id", "base", "added"])

    spans = "array<struct<start:bigint,stop:bigint,kind:string>>"
    return docs.select("doc_id", text_of().alias("text")).mapInArrow(run, f"doc_id {kind}, base {spans}, added {spans}")
