"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces with their scores.

The model file gives pieces, scores, kinds and the normaliser's switches; it is read here, never trained. A text gets the
dummy prefix, spaces become the marker U+2581, and the segmentation of the largest summed score wins; of equal
sums, the one whose last piece is longer, at each end. A character without a piece costs ``UNKNOWN`` less than the least
score and is given as its byte pieces. Decoding joins pieces and bytes, makes markers spaces and takes the dummy prefix off.
"""

from __future__ import annotations

import re
import struct
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import ranges

MARKER = "▁"
UNKNOWN = 10.0
#: piece kinds of the model format
NORMAL, UNK, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
REMEMBERED = 400_000
#: bytes up to which words are segmented side by side
SHORT = 48


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol buffer message's fields."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            b = data[at]
            value |= (b & 127) << shift
            at, shift = at + 1, shift + 7
            if b < 128:
                return value, at

    at = 0
    while at < len(data):
        tag, at = varint(at)
        if tag & 7 == 0:
            value, at = varint(at)
        elif tag & 7 == 2:
            n, at = varint(at)
            value, at = data[at : at + n], at + n
        else:
            n = 4 if tag & 7 == 5 else 8
            value, at = data[at : at + n], at + n
        yield tag >> 3, value


@dataclass
class DoubleArray:
    """State s goes on byte c to t = base[s] + c where check[t] = s; value[t] is the piece that ends there, or -1."""

    base: np.ndarray
    check: np.ndarray
    value: np.ndarray

    @classmethod
    def build(cls, keys: dict[bytes, int]) -> DoubleArray:
        children: list[dict[int, int]] = [{}]
        ends = [-1]
        for key, v in keys.items():
            node = 0
            for c in key:
                if c not in children[node]:
                    children[node][c] = len(children)
                    children.append({})
                    ends.append(-1)
                node = children[node][c]
            ends[node] = v
        size = 2 * len(children) + 1024
        taken = np.zeros(size, bool)
        base, check, value = np.zeros(size, np.int64), np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        taken[0] = True
        value[0] = ends[0]
        # nodes of one child fill the lowest gap; the others search on from where the last one of them fitted
        low, on, queue = 256, 0, [(0, 0)]
        for node, place in queue:
            codes = np.array(sorted(children[node]), np.int64)
            if not len(codes):
                continue
            while taken[low]:
                low += 1
            # the first base at which every child falls on a free place
            b = max(0, low - int(codes[0]), on if len(codes) > 1 else 0)
            while True:
                if b + 256 >= len(taken):
                    more = len(taken)
                    taken, base = np.r_[taken, np.zeros(more, bool)], np.r_[base, np.zeros(more, np.int64)]
                    check, value = np.r_[check, np.full(more, -1)], np.r_[value, np.full(more, -1)]
                if not taken[b + codes].any():
                    break
                b += 1
            on = b if len(codes) > 1 else on
            base[place] = b
            taken[b + codes] = True
            for c in codes.tolist():
                child = children[node][c]
                check[b + c], value[b + c] = place, ends[child]
                queue.append((child, b + c))
        used = int(np.flatnonzero(taken)[-1]) + 257
        return cls(base[:used], check[:used], value[:used])


@dataclass
class Model:
    pieces: list[str]
    scores: np.ndarray
    kinds: list[int]
    dummy_prefix: bool
    trie: DoubleArray = field(repr=False)
    unknown: float
    unknown_id: int
    byte_ids: np.ndarray
    longest: int
    #: no piece goes on past a marker that follows another character, so that words can be segmented alone
    by_word: bool

    @classmethod
    def load(cls, file: str) -> Model:
        with open(file, "rb") as f:
            data = f.read()
        pieces, scores, kinds, dummy = [], [], [], True
        for number, value in fields(data):
            if number == 1:
                piece = dict(fields(value))
                pieces.append(piece.get(1, b"").decode())
                scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                kinds.append(piece.get(3, NORMAL))
            elif number == 3:
                dummy = bool(dict(fields(value)).get(3, 1))
        return cls.of(pieces, scores, kinds, dummy)

    @classmethod
    def of(cls, pieces: list[str], scores: list[float], kinds: list[int], dummy_prefix: bool = True) -> Model:
        keys = {p.encode(): i for i, (p, k) in enumerate(zip(pieces, kinds, strict=True)) if k in (NORMAL, USER) and p}
        unknown_id = next((i for i, k in enumerate(kinds) if k == UNK), 0)
        byte_ids = np.full(256, -1, np.int64)
        for i, (p, k) in enumerate(zip(pieces, kinds, strict=True)):
            if k == BYTE:
                byte_ids[int(p[3:5], 16)] = i
        if (byte_ids < 0).any():
            byte_ids[:] = unknown_id
        least = min((scores[i] for i in keys.values()), default=0.0)
        by_word = not any(MARKER in p.lstrip(MARKER) for p in pieces)
        return cls(pieces, np.array(scores, float), kinds, dummy_prefix, DoubleArray.build(keys), least - UNKNOWN, unknown_id, byte_ids, max(map(len, keys), default=1), by_word)

    def normal(self, text: str) -> str:
        """The text with markers for spaces, after the dummy prefix; an empty text stays empty."""
        return (MARKER * self.dummy_prefix + text.replace(" ", MARKER)) if text else ""

    def segment(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words one after the other, ids in each), by Viterbi over the bytes of all the words at once."""
        n = len(words)
        sizes = np.array([len(w) for w in words], np.int64)
        longest = int(sizes.max()) if n else 0
        data = np.zeros((n, longest + 1), np.int64)
        data[np.repeat(np.arange(n), sizes), ranges(np.zeros(n, np.int64), sizes)] = np.frombuffer(b"".join(words), np.uint8)
        inner = data & 0xC0 == 0x80
        best = np.full((n, longest + 1), -np.inf)
        best[:, 0] = 0
        # within a character, and where it has no piece, its bytes stand alone
        came = np.broadcast_to(np.arange(-1, longest), (n, longest + 1)).copy()
        piece = np.zeros((n, longest + 1), np.int64)
        piece[:, 1:] = self.byte_ids[data[:, :-1]]
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        for i in range(longest):
            rows = np.flatnonzero((sizes > i) & ~inner[:, i] & np.isfinite(best[:, i]))
            if not len(rows):
                continue
            width = np.ones(len(rows), np.int64)
            for k in range(1, 4):
                if i + k <= longest:
                    width += (width == k) & inner[rows, i + k]
            whole = np.zeros(len(rows), bool)
            state, live = np.zeros(len(rows), np.int64), np.arange(len(rows))
            for j in range(i, min(longest, i + self.longest)):
                r = rows[live]
                to = base[state] + data[r, j]
                go = (check[to] == state) & (j < sizes[r])
                live, state, r = live[go], to[go], r[go]
                if not len(live):
                    break
                v = value[state]
                end = np.flatnonzero(v >= 0)
                if len(end):
                    at = r[end]
                    whole[live[end]] |= width[live[end]] == j + 1 - i
                    total = best[at, i] + self.scores[v[end]]
                    better = total > best[at, j + 1]
                    at, total = at[better], total[better]
                    best[at, j + 1], came[at, j + 1], piece[at, j + 1] = total, i, v[end][better]
            bare = ~whole
            if bare.any():
                at, end = rows[bare], i + width[bare]
                total = best[at, i] + self.unknown
                better = total > best[at, end]
                at, end, total = at[better], end[better], total[better]
                best[at, end], came[at, end], piece[at, end] = total, end - 1, self.byte_ids[data[at, end - 1]]
        counts = np.zeros(n, np.int64)
        back = np.zeros((n, max(1, longest)), np.int64)
        where, rows = sizes.copy(), np.flatnonzero(sizes > 0)
        while len(rows):
            back[rows, counts[rows]] = piece[rows, where[rows]]
            counts[rows] += 1
            where[rows] = came[rows, where[rows]]
            rows = rows[where[rows] > 0]
        return back[np.repeat(np.arange(n), counts), np.repeat(counts, counts) - 1 - ranges(np.zeros(n, np.int64), counts)], counts


class Encoder:
    """Ids of whole texts; the ids of words seen before are remembered."""

    WORDS = re.compile(f"{MARKER}*[^{MARKER}]+|{MARKER}+")

    def __init__(self, model: Model) -> None:
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.ends = array("i"), array("q", [0])

    def learn(self, words: list[str]) -> None:
        encoded = sorted(((w.encode(), w) for w in words), key=lambda x: len(x[0]))
        at = 0
        while at < len(encoded):
            end, size = at, len(encoded[at][0])
            # words of like lengths side by side; long ones in small company
            limit = 20_000 if size <= SHORT else max(1, 500_000 // (size + 1))
            while end < len(encoded) and end - at < limit and len(encoded[end][0]) <= max(8, size + size // 2):
                end += 1
            ids, counts = self.model.segment([b for b, _ in encoded[at:end]])
            for (_, w), n in zip(encoded[at:end], counts.tolist(), strict=True):
                self.known[w] = len(self.ends) - 1
                self.ends.append(self.ends[-1] + n)
            self.flat.frombytes(ids.astype(np.int32).tobytes())
            at = end

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, ids in each)."""
        if len(self.known) > REMEMBERED:
            self.forget()
        normal = map(self.model.normal, texts)
        split = list(map(self.WORDS.findall, normal)) if self.model.by_word else [[t] if t else [] for t in normal]
        known = self.known
        self.learn(list({w for ws in split for w in ws if w not in known}))
        flat, ends = np.array(self.flat, np.int32), np.array(self.ends, np.int64)
        words = np.fromiter(map(known.__getitem__, chain.from_iterable(split)), np.int64)
        sizes = ends[words + 1] - ends[words]
        of = np.repeat(np.arange(len(texts)), [len(ws) for ws in split])
        return flat[ranges(ends[words], sizes)], np.bincount(of, sizes, minlength=len(texts)).astype(np.int64)


class Decoder:
    def __init__(self, model: Model) -> None:
        self.dummy_prefix = model.dummy_prefix
        self.bytes = [bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else " ⁇ ".encode() if k == UNK else p.replace(MARKER, " ").encode() for p, k in zip(model.pieces, model.kinds, strict=True)]

    def __call__(self, ids: list[int]) -> str:
        data = b"".join(map(self.bytes.__getitem__, ids))
        if self.dummy_prefix and data[:1] == b" ":
            data = data[1:]
        return data.decode("utf-8", "replace")


def encoded(documents: DataFrame, model: Model, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """documents with ids_col, the ids of each whole text, in the place of text_col; null texts have null ids, empty ones none.

    Also n_tokens, n_byte_pieces and round_trip: whether decoding the ids gives the text again, which a text with a
    marker character of its own doesn't. Columns of these names are replaced.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)
    made = [ids_col, "n_tokens", "n_byte_pieces", "round_trip"]
    rest = [c for c in documents.columns if c not in (*made, text_col)]
    kinds = {f.name: f.dataType.simpleString() for f in documents.schema.fields}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in rest), f"`{ids_col}` array<int>", "n_tokens long", "n_byte_pieces long", "round_trip boolean"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, decode = Encoder(shared.value), Decoder(shared.value)
        is_byte = np.array([k == BYTE for k in shared.value.kinds])
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                texts = batch.column(text_col)
                null = np.asarray(texts.is_null())
                strings = texts.fill_null("").to_pylist()
                ids, counts = encode(strings)
                ends = np.cumsum(counts)
                bounds = np.r_[0, ends]
                in_bytes = np.r_[0, np.cumsum(is_byte[ids])]
                plain = ids.tolist()
                same = [decode(plain[s:e]) == t for s, e, t in zip(bounds[:-1].tolist(), ends.tolist(), strings, strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids, pa.int32()), mask=pa.array(null))
                columns = [*(batch.column(c) for c in rest), lists, pa.array(counts), pa.array(in_bytes[ends] - in_bytes[bounds[:-1]]), pa.array(same, pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, [*rest, *made])

    return documents.select(*rest, text_col).mapInArrow(run, schema)


def decoded(rows: DataFrame, model: Model, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """rows with text_col, the text of ids_col, in its place; null ids have a null text."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    rest = [c for c in rows.columns if c not in (ids_col, text_col)]
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = Decoder(shared.value)
        for batch in batches:
            texts = [None if ids is None else decode(ids) for ids in batch.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(texts, pa.string())], [*rest, text_col])

    return rows.select(*rest, ids_col).mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in rest), f"`{text_col}` string"]))


def token_rows(documents: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, ids, n_tokens, n_byte_pieces, round_trip. Null ids stay; null texts have null ids; rows that repeat an id get a row each."""
    return encoded(documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), Model.load(model_file))
