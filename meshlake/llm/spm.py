"""SentencePiece merge-type (BPE) encoding by backtracking, and decoding.

The encoder never runs merges over a text. It takes the longest piece that an
Aho-Corasick automaton finds at each position, and keeps it if it can stand
after the piece before: that is so if merging the two pieces' characters anew
gives exactly these two. If not, the next shorter piece is tried; if none is
left, the position is marked as failed in a bitfield and the piece before is
taken back. Answers on pairs are remembered.

Texts are cut where no piece can cross: before a run of the space mark, and
around characters outside the vocabulary, which become byte pieces. What lies
between is encoded once and remembered, up to a bound.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from meshlake.llm.common import small_batches, text_of, tidy

MARK = "▁"
_SEGMENT = re.compile(r" +[^ \n]*|[^ \n]+|\n+")
#: Bounds on what a worker remembers: segments of each of two generations, pairs, and characters of a segment worth remembering.
MAX_SEGMENTS, MAX_PAIRS, MAX_LENGTH = 80_000, 250_000, 64


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@dataclass(frozen=True)
class Vocabulary:
    """The tables of a model: a few MB, whatever the corpus."""

    pieces: list[str]
    scores: list[float]
    kinds: list[int]  # 1 normal, 2 unknown, 3 control, 4 user-defined, 5 unused, 6 byte
    eos: int
    usable: list[int] = field(default_factory=list)

    def merge(self, text: str, ids: dict[str, int]) -> list[int]:
        """Merging as the model defines it: the best-scored adjacent pair first, the leftmost of equal ones."""
        parts = list(text)
        while True:
            best, where = None, -1
            for k in range(len(parts) - 1):
                at = ids.get(parts[k] + parts[k + 1])
                if at is not None and (best is None or self.scores[at] > best):
                    best, where = self.scores[at], k
            if best is None:
                return [ids[p] for p in parts]
            parts[where : where + 2] = [parts[where] + parts[where + 1]]


def load_model(path: str) -> Vocabulary:
    """Read a model file. ValueError if it isn't of the kind that this encoder covers."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    norm, spec = model.normalizer_spec, model.trainer_spec
    if spec.model_type != spec.BPE or not spec.byte_fallback or not spec.split_by_whitespace or spec.treat_whitespace_as_suffix:
        raise ValueError("a BPE model with byte fallback that splits by white space is needed")
    if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or not norm.escape_whitespaces:
        raise ValueError("a model without normalisation, with a dummy prefix, is needed")
    kinds = [p.type for p in model.pieces]
    pieces = [p.piece for p in model.pieces]
    if {4, 5} & set(kinds) or any(k == 1 and re.search(f"[^{MARK}]{MARK}", p) for k, p in zip(kinds, pieces, strict=True)):
        raise ValueError("user-defined or unused pieces, or pieces across words, aren't covered")
    if any(k == 1 and "\n" in p and set(p) != {"\n"} for k, p in zip(kinds, pieces, strict=True)):
        raise ValueError("pieces that join line ends with other characters aren't covered")
    vocab = Vocabulary(pieces, [p.score for p in model.pieces], kinds, kinds.index(3, pieces.index("</s>")))
    ids = {p: i for i, p in enumerate(pieces) if kinds[i] == 1}
    single = {p for p in ids if len(p) == 1}
    usable = [i for p, i in ids.items() if set(p) <= single and vocab.merge(p, ids) == [i]]
    return Vocabulary(vocab.pieces, vocab.scores, vocab.kinds, vocab.eos, usable)


class _Remembered(dict):
    """Segment to packed ids; computes what is missing. What a full generation held is looked up until the next is full."""

    def __init__(self, make):
        self.make, self.older = make, {}

    def __missing__(self, segment: str) -> bytes:
        out = self.older.get(segment)
        if out is None:
            out = self.make(segment.replace(" ", MARK))
        if len(segment) <= MAX_LENGTH:
            if len(self) >= MAX_SEGMENTS:
                self.older = dict(self)
                self.clear()
            self[segment] = out
        return out


class Codec:
    """Encoder and decoder over a vocabulary; one per worker."""

    def __init__(self, vocab: Vocabulary):
        import ahocorasick

        self.vocab = vocab
        self.ids = {p: i for i, p in enumerate(vocab.pieces) if vocab.kinds[i] == 1}
        usable = set(vocab.usable)
        self.found = ahocorasick.Automaton()
        self.length = [len(p) for p in vocab.pieces]
        self.shorter = [-1] * len(vocab.pieces)
        for i in vocab.usable:
            p = vocab.pieces[i]
            self.found.add_word(p, i)
            self.shorter[i] = next((j for n in range(len(p) - 1, 0, -1) if (j := self.ids.get(p[:n], -1)) in usable), -1)
        self.found.make_automaton()
        self.single = {p for p in self.ids if len(p) == 1}
        self.byte_ids = {int(p[3:5], 16): i for i, p in enumerate(vocab.pieces) if vocab.kinds[i] == 6}
        self.byte_of = {i: b for b, i in self.byte_ids.items()}
        self.pairs: dict[int, bool] = {}
        self.remembered = _Remembered(self._segment)
        surface = [p.replace(MARK, " ").encode() for p in vocab.pieces]
        for i, kind in enumerate(vocab.kinds):
            if kind == 6:
                surface[i] = bytes([self.byte_of[i]])
            elif kind != 1:
                surface[i] = " ⁇ ".encode() if kind == 2 else b""
        self.surface = surface

    def _fits(self, left: int, right: int) -> bool:
        key = left << 32 | right
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= MAX_PAIRS:
                self.pairs.clear()
            v = self.vocab
            known = self.pairs[key] = v.merge(v.pieces[left] + v.pieces[right], self.ids) == [left, right]
        return known

    def _backtrack(self, text: str) -> list[int]:
        """The one sequence of pieces, of known characters, in which all neighbours fit."""
        n, length, shorter = len(text), self.length, self.shorter
        longest = [-1] * n
        for end, i in self.found.iter(text):
            start = end - length[i] + 1
            if longest[start] < 0 or length[i] > length[longest[start]]:
                longest[start] = i
        failed = bytearray((n >> 3) + 1)
        out: list[int] = []
        at, piece = 0, longest[0]
        while at < n:
            last = out[-1] if out else -1
            while piece >= 0:
                end = at + length[piece]
                if not failed[end >> 3] >> (end & 7) & 1 and (last < 0 or self._fits(last, piece)):
                    break
                piece = shorter[piece]
            if piece >= 0:
                out.append(piece)
                at = end
                piece = longest[at] if at < n else -1
            else:
                failed[at >> 3] |= 1 << (at & 7)
                if not out:
                    raise ValueError("no sequence of pieces fits")
                piece = out.pop()
                at -= length[piece]
        return out

    def _segment(self, segment: str) -> bytes:
        """Packed ids of a segment; characters outside the vocabulary become their bytes."""
        ids: list[int] = []
        if self.single.issuperset(segment):
            ids = self._backtrack(segment)
        else:
            start, n = 0, len(segment)
            while start < n:
                stop = start
                while stop < n and segment[stop] in self.single:
                    stop += 1
                if stop > start:
                    ids += self._backtrack(segment[start:stop])
                else:
                    ids += [self.byte_ids[b] for b in segment[start].encode()]
                    stop += 1
                start = stop
        return array("i", ids).tobytes()

    def encode(self, text: str) -> bytes:
        """Ids as packed 32-bit integers, with the end id. A space mark in the text is a space."""
        end = array("i", [self.vocab.eos]).tobytes()
        if not text:
            return end
        segments = _SEGMENT.findall(" " + text.replace(MARK, " "))
        return b"".join(map(self.remembered.__getitem__, segments)) + end

    def decode(self, ids: list[int]) -> str:
        """The text: the dummy prefix goes; bytes that aren't UTF-8 become U+FFFD each."""
        out = b"".join(map(self.surface.__getitem__, ids))
        first = next((i for i in ids if self.vocab.kinds[i] != 3), -1)
        if first >= 0 and self.vocab.kinds[first] == 1 and self.vocab.pieces[first].startswith(MARK):
            out = out[1:]
        try:
            return out.decode()
        except UnicodeDecodeError:
            return self._lenient(ids)

    def _lenient(self, ids: list[int]) -> str:
        out, run = [], bytearray()

        def flush() -> None:
            k = 0
            while k < len(run):
                for n in (1, 2, 3, 4):
                    try:
                        out.append(run[k : k + n].decode())
                        k += n
                        break
                    except UnicodeDecodeError:
                        pass
                else:
                    out.append("�")
                    k += 1
            run.clear()

        fresh = True
        for i in ids:
            if i in self.byte_of:
                run.append(self.byte_of[i])
                fresh = False
                continue
            flush()
            text = self.surface[i].decode()
            out.append(text[1:] if fresh and self.vocab.kinds[i] == 1 and text.startswith(" ") else text)
            fresh = fresh and self.vocab.kinds[i] == 3
        flush()
        return "".join(out)


_codecs: dict[str, Codec] = {}


def encode_decode(docs: DataFrame, model: str | None = None) -> DataFrame:
    """One row per row of ``docs(doc_id, text, ...)``: ``doc_id, ids, decoded``.

    ``ids`` are the pieces of the whole text with the end id, ``decoded`` what they
    decode to. Null text counts as empty and has just the end id. Repeated rows and
    null ids are rows like others; an empty table gives no rows; other columns aren't
    read. The model's tables (a vocabulary, fixed in size) are broadcast.
    """
    import numpy as np
    import pyarrow as pa

    spark = docs.sparkSession
    small_batches(spark)
    path = model or default_model()
    vocab = spark.sparkContext.broadcast(load_model(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codecs.get(path)
        if codec is None:
            codec = _codecs[path] = Codec(vocab.value)
        for batch in batches:
            packed = [codec.encode(t) for t in batch.column(1).to_pylist()]
            flat = np.frombuffer(b"".join(packed), dtype=np.int32)
            offsets = np.zeros(len(packed) + 1, dtype=np.int32)
            np.cumsum([len(p) >> 2 for p in packed], out=offsets[1:])
            decoded = [codec.decode(np.frombuffer(p, dtype=np.int32).tolist()) for p in packed]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array(decoded, pa.string())],
                names=["doc_id", "ids", "decoded"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", text_of().alias("text"))
    return rows.mapInArrow(tidy(run), f"doc_id {kind}, ids array<int>, decoded string")
