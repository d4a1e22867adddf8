"""Token-id files: an adaptive context-mixing range coder over independently reset, checksummed blocks.

A file is a header, a table of documents and blocks of at most ``BLOCK_IDS`` ids. A block numbers its distinct ids by their
first places; three models predict the number of the next id, from the two before it (order 2), from one (order 1) and
from how often each has occurred (order 0). All that is written of an id goes through the range coder:

* the favoured of the predictions is it or isn't. The probability mixes the three orders' estimates in the logistic domain,
  with weights and hit rates that learn;
* if it isn't, it is coded by order 0's adaptive counts, without the favoured one. New ids share an escape that counts as
  often as there have been new ones;
* a new id follows as its class (its length in bits and its highest three bits), by adaptive counts, and its other bits.

Models start anew in each block, so a damaged block costs no other, and blocks are coded side by side: one step of
numpy takes the next id of every block. All model arithmetic is on integers, so every machine decodes alike.
"""

from __future__ import annotations

import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain
from math import exp

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlens.llm.common import new_path, ranges, texts_of, written

MAGIC = b"FLTOK002"
BLOCK_IDS = 4096
#: blocks coded side by side and held in memory
LANES = 1024
#: order 0 keeps sums of so many numbers, and of so many such groups
GROUP = 64
#: places for the contexts of order 2
ORDER2 = 4096
#: ids of at most 32 bits: 0 to 3, then four for each length
CLASSES = 124
#: how much one new id adds to its class
CLASS_STEP = 6
END = 2
#: tasks that read files, at most; beyond that a task reads several
READERS = 10_000
#: distinct pieces of text whose ids a worker remembers
REMEMBERED = 600_000

#: logistic scale: probabilities of 12 bits, their log odds in steps of 1/256 within +-2047
_SQUASH = np.array([min(4095, max(1, round(4096 / (1 + exp(-x / 256))))) for x in range(-2047, 2048)], np.int64)
_STRETCH = (np.searchsorted(_SQUASH, np.arange(4096)).clip(0, 4094) - 2047).astype(np.int64)
#: row k: what an occurrence of k adds to the running sums
_FROM = np.tri(GROUP, dtype=np.int16).T.copy()
_CLASS_FROM = np.tri(CLASSES, dtype=np.int16).T * np.int16(CLASS_STEP)
_HALF = np.uint64(32)


def unsigned(x: np.ndarray) -> np.ndarray:
    return np.asarray(x).astype(np.uint64)


class Coder:
    """A carryless range coder for each lane: ranges of 64 bits that move by words of 32. It reads data, if there are any, else writes."""

    def __init__(self, lanes: int, data: np.ndarray | None = None, starts: np.ndarray | None = None) -> None:
        self.low, self.size = np.zeros(lanes, np.uint64), np.full(lanes, (1 << 64) - 1, np.uint64)
        self.data = data
        if data is None:
            self.out, self.used = np.zeros((lanes, BLOCK_IDS // 4 + 64), np.uint32), np.zeros(lanes, np.int64)
        else:
            self.at = starts + 2
            self.x = unsigned(data[starts]) << _HALF | data[starts + 1]

    def value(self, lanes: np.ndarray, total: np.ndarray) -> np.ndarray:
        """The number below total that each lane's code stands for."""
        found = (self.x[lanes] - self.low[lanes]) // (self.size[lanes] // unsigned(total))
        return np.minimum(found, unsigned(total) - np.uint64(1)).astype(np.int64)

    def code(self, lanes: np.ndarray, start: np.ndarray, width: np.ndarray, total: np.ndarray) -> None:
        """Narrows the lanes' ranges to the part from start to start + width of total."""
        start, width, total = unsigned(start), unsigned(width), unsigned(total)
        size = self.size[lanes]
        step = size // total
        low = self.low[lanes] + step * start
        size = np.where(start + width == total, size - step * start, step * width)
        small = np.flatnonzero(size >> _HALF == 0)
        if len(small):
            # the upper word is settled, as the range is cut where it would change
            at, l = lanes[small], low[small]
            n = np.minimum(size[small] - np.uint64(1), ~l & np.uint64(0xFFFFFFFF)) + np.uint64(1)
            if self.data is None:
                if self.used.max() >= self.out.shape[1] - 4:
                    self.out = np.concatenate((self.out, np.zeros_like(self.out)), 1)
                self.out[at, self.used[at]] = l >> _HALF
                self.used[at] += 1
            else:
                self.x[at] = self.x[at] << _HALF | self.data[self.at[at]]
                self.at[at] += 1
            low[small], size[small] = l << _HALF, n << _HALF
        self.low[lanes], self.size[lanes] = low, size

    def finish(self) -> list[bytes]:
        """Two more words settle where in its range each lane's number lies."""
        last = (self.low + (self.size >> np.uint64(1))).astype(">u8").tobytes()
        ends = np.frombuffer(last, ">u4").reshape(-1, 2)
        return [np.r_[self.out[i, :n], ends[i]].astype("<u4").tobytes() for i, n in enumerate(self.used)]


class Models:
    """The predictions of all lanes, in numbers of a block's distinct ids; every array's first dimension is the lane."""

    def __init__(self, lanes: int) -> None:
        self.lane, self.groups = np.arange(lanes), BLOCK_IDS // GROUP
        # order 0: running sums of occurrences over the groups, and within each
        self.across = np.zeros((lanes, self.groups), np.int16)
        self.within = np.zeros((lanes * self.groups, GROUP), np.int16)
        self.seen, self.known = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
        self.ids = np.zeros((lanes, BLOCK_IDS), np.uint32)
        self.classes = np.tile(np.arange(1, CLASSES + 1, dtype=np.int16), (lanes, 1))
        # orders 1 and 2: what followed a context, plus one, and how often that has held
        self.next1, self.sure1 = np.zeros(lanes * (BLOCK_IDS + 1), np.int16), np.zeros(lanes * (BLOCK_IDS + 1), np.int8)
        self.next2, self.sure2 = np.zeros(lanes * ORDER2, np.int16), np.zeros(lanes * ORDER2, np.int8)
        self.last, self.before = np.full(lanes, BLOCK_IDS), np.full(lanes, BLOCK_IDS)
        # hit rates (16 bits) by how often the predictions have held, and weights by which orders back the favoured one
        self.hit1, self.hit2 = np.full(lanes * 32, 1 << 13), np.full(lanes * 32, 1 << 13)
        self.weight = [np.full(lanes * 4, 1 << 15) for _ in range(3)]

    def counted(self, lanes: np.ndarray, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(occurrences of lower numbers, of this one)."""
        g, k = slot >> 6, slot & GROUP - 1
        flat = (lanes * self.groups + g) * GROUP + k
        within = self.within.reshape(-1)
        under = within.take(flat - 1) * (k > 0)
        base = self.across.reshape(-1).take(lanes * self.groups + g - 1) * (g > 0)
        return base.astype(np.int64) + under, (within.take(flat) - under).astype(np.int64)

    def predict(self) -> tuple[np.ndarray, np.ndarray]:
        """(the favoured number, the probability of 4096 that it is next)."""
        self.at1 = self.lane * (BLOCK_IDS + 1) + self.last
        self.at2 = self.lane * ORDER2 + ((self.last * 0x9E3779B1 ^ self.before * 0x85EBCA6B) >> 7 & ORDER2 - 1)
        self.was1, self.was2 = self.next1.take(self.at1), self.next2.take(self.at2)
        self.held1, self.held2 = self.sure1.take(self.at1), self.sure2.take(self.at2)
        two = (self.was2 > 0) & ((self.held2 > 0) | (self.held1 == 0))
        # where neither order has a prediction, number 0 stands in
        self.slot = np.maximum(np.where(two, self.was2, self.was1).astype(np.int64) - 1, 0)
        self.under, self.count = self.counted(self.lane, self.slot)
        back1, back2 = self.was1 == self.slot + 1, self.was2 == self.slot + 1
        self.c1 = self.lane * 32 + np.where(back1, 1 + self.held1, 0) + 16 * back2
        self.c2 = self.lane * 32 + np.where(back2, 1 + self.held2, 0) + 16 * back1
        self.cw = self.lane * 4 + back1 + 2 * back2
        share = np.minimum((self.count << 12) // np.maximum(self.seen + self.known, 1), 4095)
        self.s = _STRETCH.take(self.hit2.take(self.c2) >> 4), _STRETCH.take(self.hit1.take(self.c1) >> 4), _STRETCH.take(share)
        self.w = [w.take(self.cw) for w in self.weight]
        mixed = sum(w * s for w, s in zip(self.w, self.s, strict=True)) >> 16
        self.p = _SQUASH.take(mixed + 2047, mode="clip")
        return self.slot, self.p

    def learn(self, slot: np.ndarray, hit: np.ndarray) -> None:
        error = (hit.astype(np.int64) << 12) - self.p
        for table, w, s in zip(self.weight, self.w, self.s, strict=True):
            table[self.cw] = np.minimum(w + (error * s >> 8), 1 << 20)
        goal = hit.astype(np.int64) * 65535
        for rate, c in ((self.hit1, self.c1), (self.hit2, self.c2)):
            had = rate.take(c)
            rate[c] = had + ((goal - had) >> 4)
        new = (slot + 1).astype(np.int16)
        for table, sure, at, was, held in ((self.next1, self.sure1, self.at1, self.was1, self.held1), (self.next2, self.sure2, self.at2, self.was2, self.held2)):
            right = was == new
            sure[at] = np.where(right, np.minimum(held + 1, 7), held >> 1)
            # a prediction that has held keeps its place for a while
            table[at] = np.where(right | (held > 1), was, new)
        g = slot >> 6
        row = self.lane * self.groups + g
        self.within[row] = self.within.take(row, 0) + _FROM.take(slot & GROUP - 1, 0)
        self.across += _FROM.take(g, 0)
        self.seen += 1
        self.before, self.last = self.last, slot

    def add(self, lanes: np.ndarray, ids: np.ndarray, kind: np.ndarray) -> None:
        """ids get the next numbers of their lanes."""
        self.ids[lanes, self.known[lanes]] = ids
        self.known[lanes] += 1
        self.classes[lanes] = self.classes.take(lanes, 0) + _CLASS_FROM.take(kind, 0)


def kinds(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class, lower bits, number of lower bits) of ids."""
    ids = ids.astype(np.int64)
    bits = np.maximum(np.frexp(ids.astype(float))[1].astype(np.int64) - 3, 0)
    return (ids >> bits) + 4 * bits, ids & (1 << bits) - 1, bits


def spelled(coder: Coder, models: Models, lanes: np.ndarray, ids: np.ndarray | None = None) -> np.ndarray:
    """Codes new ids (or reads them), class first."""
    at = np.arange(len(lanes))
    row = models.classes.take(lanes, 0)
    total = row[:, -1].astype(np.int64)
    if ids is None:
        kind = (row > coder.value(lanes, total).astype(np.int16)[:, None]).argmax(1)
        bits = np.maximum(kind - 4 >> 2, 0)
        rest = np.zeros(len(lanes), np.int64)
    else:
        kind, rest, bits = kinds(ids)
    start = np.where(kind > 0, row[at, kind - 1], 0)
    coder.code(lanes, start, row[at, kind] - start, total)
    for shift in (16, 0):
        width = np.minimum(np.maximum(bits - shift, 0), 16)
        if width.any():
            total = np.int64(1) << width
            part = coder.value(lanes, total) if ids is None else rest >> shift & total - 1
            coder.code(lanes, part, np.ones(len(lanes)), total)
            if ids is None:
                rest |= part << shift
    if ids is None:
        ids = (kind - 4 * bits << bits) + rest
    models.add(lanes, ids, kind)
    return ids


def step(coder: Coder, models: Models, live: np.ndarray, slot: np.ndarray, ids: np.ndarray | None = None) -> None:
    """The next id of the live lanes. With ids, slot holds their numbers; else the numbers that are read go to slot."""
    favoured, p = models.predict()
    if ids is None:
        hit = np.zeros(len(slot), bool)
        hit[live] = coder.value(live, np.full(len(live), 4096)) < p[live]
        slot[:] = favoured
    else:
        hit = (favoured == slot) & (models.known > 0)
    h, q = hit[live], p[live]
    coder.code(live, np.where(h, 0, q), np.where(h, q, 4096 - q), np.full(len(live), 4096))
    miss = live[~h]
    if len(miss):
        without, known, mine = models.count[miss], models.known[miss], favoured[miss]
        seen, escape = models.seen[miss] - without, np.maximum(known, 1)
        if ids is None:
            at = coder.value(miss, seen + escape)
            old = at < seen
            at = np.where(old, at + without * (at >= models.under[miss]), 0)
            at = at.astype(np.int16)[:, None]
            g = (models.across.take(miss, 0) > at).argmax(1)
            at[:, 0] -= np.where(g > 0, models.across[miss, g - 1], 0).astype(np.int16)
            slot[miss] = np.where(old, g * GROUP + (models.within.take(miss * models.groups + g, 0) > at).argmax(1), known)
        else:
            old = slot[miss] < known
        under, count = models.counted(miss, np.minimum(slot[miss], BLOCK_IDS - 1))
        coder.code(miss, np.where(old, under - without * (slot[miss] > mine), seen), np.where(old, count, escape), seen + escape)
        new = miss[~old]
        if len(new):
            spelled(coder, models, new, None if ids is None else ids[new])
    models.learn(slot, hit)


def numbered(block: np.ndarray) -> np.ndarray:
    """The ids' numbers, by first places."""
    _, first, which = np.unique(block, return_index=True, return_inverse=True)
    number = np.empty(len(first), np.int64)
    number[np.argsort(first)] = np.arange(len(first))
    return number[which]


def encode_blocks(ids: np.ndarray) -> bytes:
    """Blocks of ids, each with its header: counts, words and the checksum of its ids."""
    blocks = [ids[at : at + BLOCK_IDS] for at in range(0, len(ids), BLOCK_IDS)]
    if not blocks:
        return b""
    sizes = np.array([len(b) for b in blocks])
    slots, grid = np.zeros((BLOCK_IDS, len(blocks)), np.int16), np.zeros((BLOCK_IDS, len(blocks)), np.uint32)
    for i, b in enumerate(blocks):
        slots[: len(b), i], grid[: len(b), i] = numbered(b), b
    models, coder = Models(len(blocks)), Coder(len(blocks))
    for k in range(int(sizes.max())):
        live = models.lane if sizes[-1] > k else np.flatnonzero(sizes > k)
        step(coder, models, live, slots[k].astype(np.int64), grid[k])
    out = []
    for b, words in zip(blocks, coder.finish(), strict=True):
        out += [struct.pack("<III", len(b), len(words) // 4, zlib.crc32(b.astype("<u4").tobytes())), words]
    return b"".join(out)


def decode_blocks(data: bytes) -> np.ndarray:
    """The ids of consecutive blocks; a block that doesn't match its checksum is an error."""
    heads, at = [], 0
    while at < len(data):
        n, words, crc = struct.unpack_from("<III", data, at)
        heads.append((n, at // 4 + 3, crc))
        at += 12 + 4 * words
    if not heads:
        return np.zeros(0, np.uint32)
    sizes, starts, crcs = np.array(heads, np.int64).T
    models = Models(len(heads))
    coder = Coder(len(heads), np.r_[np.frombuffer(data, "<u4"), np.zeros(2 * BLOCK_IDS, np.uint32)], starts)
    out = np.zeros((int(sizes.max()), len(heads)), np.int64)
    for k in range(len(out)):
        step(coder, models, models.lane if sizes.min() > k else np.flatnonzero(sizes > k), out[k])
    blocks = []
    for i in range(len(heads)):
        block = models.ids[i][out[: sizes[i], i]].astype("<u4")
        if zlib.crc32(block.tobytes()) != crcs[i]:
            raise ValueError("a block doesn't match its checksum")
        blocks.append(block)
    return np.concatenate(blocks)


def pack(doc_ids: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> bytes:
    """A file: magic, sizes, checksummed table of documents, groups of blocks."""
    table = zlib.compress(doc_ids.astype("<i8").tobytes() + counts.astype("<i8").tobytes(), 1)
    out = [MAGIC, struct.pack("<QQII", len(doc_ids), len(ids), len(table), zlib.crc32(table)), table]
    for at in range(0, len(ids), LANES * BLOCK_IDS):
        blocks = encode_blocks(ids[at : at + LANES * BLOCK_IDS])
        out += [struct.pack("<Q", len(blocks)), blocks]
    return b"".join(out)


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc_ids, counts, ids) of a file."""
    n_docs, n_ids, size, crc = struct.unpack_from("<QQII", data, 8)
    table = data[32 : 32 + size]
    if data[:8] != MAGIC or zlib.crc32(table) != crc:
        raise ValueError("not a token file, or its table is damaged")
    table = np.frombuffer(zlib.decompress(table), "<i8")
    at, parts = 32 + size, []
    while at < len(data):
        m = struct.unpack_from("<Q", data, at)[0]
        parts.append(decode_blocks(data[at + 8 : at + 8 + m]))
        at += 8 + m
    ids = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
    if len(ids) != n_ids:
        raise ValueError("a token file has lost blocks")
    return table[:n_docs], table[n_docs:], ids


class Pieces(dict):
    """Numbers of pieces; an unknown one gets the next number and is listed in ``fresh``."""

    def __init__(self) -> None:
        self.fresh: list[str] = []

    def __missing__(self, piece: str) -> int:
        self[piece] = number = len(self)
        self.fresh.append(piece)
        return number


class Encoder:
    """A tokenizer whose ids for each pretokenised piece are remembered; the ids are those that it gives for the whole text.

    Byte-level pieces never merge across the pretokenizer's pattern, so that a text's ids are those of its pieces, one
    after the other. Texts with characters from U+0530 on, or with a special token in them, go to the tokenizer whole.
    """

    #: the pretokenizer's pattern, for characters below U+0530
    PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_²³¹¼½¾]+| ?[\d²³¹¼½¾]+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")

    def __init__(self, file: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.forget()

    def forget(self) -> None:
        self.known = Pieces()
        self.flat, self.ends = array("i"), array("q", [0])

    def learn(self) -> None:
        for at in range(0, len(self.known.fresh), 50_000):
            for e in self.tokenizer.encode_batch_fast(self.known.fresh[at : at + 50_000], add_special_tokens=False):
                self.flat.extend(e.ids)
                self.ends.append(len(self.flat))
        self.known.fresh.clear()

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, ids in each)."""
        if len(self.known) > REMEMBERED:
            self.forget()
        find = self.PIECES.findall
        split = [find(t) if (t.isascii() or max(t) < "\u0530") and not any(s in t for s in self.special) else [] for t in texts]
        pieces = np.fromiter(map(self.known.__getitem__, chain.from_iterable(split)), np.int64)
        self.learn()
        flat, ends = np.frombuffer(self.flat, np.int32) if self.flat else np.zeros(0, np.int32), np.frombuffer(self.ends, np.int64)
        sizes = ends[pieces + 1] - ends[pieces]
        ids = flat[ranges(ends[pieces], sizes)].astype(np.uint32)
        # arrays that are looked into can't grow
        del flat, ends
        of = np.repeat(np.arange(len(texts)), [len(ps) for ps in split])
        counts = np.bincount(of, sizes, minlength=len(texts)).astype(np.int64)
        whole = [i for i, (t, ps) in enumerate(zip(texts, split, strict=True)) if t and not ps]
        if whole:
            rows = np.split(ids, np.cumsum(counts)[:-1])
            for i in whole:
                rows[i] = np.array(self.tokenizer.encode(texts[i], add_special_tokens=False).ids, np.uint32)
                counts[i] = len(rows[i])
            ids = np.concatenate(rows)
        return ids, counts


def write_files(documents: DataFrame, tokenizer_file: str, path: str, end_id: int = END) -> DataFrame:
    """Writes (doc_id, text) as token files below path in ascending doc_id order; returns (part, seq, file, n_ids), a row for each file.

    Documents are dealt out by ranges of doc_id; a task cuts its range into files of about LANES * BLOCK_IDS ids. A file
    gets its final name, which says its place, when it is whole, so that a repeated task writes the same again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        fs, root = pafs.FileSystem.from_uri(path)
        encode = Encoder(tokenizer_file)
        doc_ids: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        ids: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            nonlocal seq
            c, i = np.concatenate(counts), np.concatenate(ids)
            name = f"{root}/part-{part:06d}-{seq:06d}.tok"
            trial = f"{name}.{TaskContext.get().taskAttemptId()}.tmp"
            with fs.open_output_stream(trial, compression=None) as out:
                out.write(pack(np.concatenate(doc_ids), c, i))
            fs.move(trial, name)
            for x in (doc_ids, counts, ids):
                x.clear()
            seq += 1
            return pa.RecordBatch.from_pydict({"part": [part], "seq": [seq - 1], "file": [name], "n_ids": [len(i)]}, schema=pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("file", pa.string()), ("n_ids", pa.int64())]))

        total = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                some = batch.slice(at, 1000)
                found, n = encode(some.column("text").to_pylist())
                ends = np.cumsum(n)
                ids.append(np.insert(found, ends, end_id))
                counts.append(n + 1)
                doc_ids.append(some.column("doc_id").to_numpy())
                total += len(ids[-1])
                if total >= LANES * BLOCK_IDS:
                    yield flush()
                    total = 0
        if counts:
            yield flush()

    fs, root = pafs.FileSystem.from_uri(path)
    fs.create_dir(root, recursive=True)
    ordered = documents.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    manifest = written(ordered.mapInArrow(run, "part int, seq int, file string, n_ids long"), "token-manifest")
    # what tasks left that were lost while they wrote
    for file in fs.get_file_info(pafs.FileSelector(root)):
        if file.path.endswith(".tmp"):
            fs.delete_file(file.path)
    return manifest


def read_files(manifest: DataFrame, path: str, ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of the documents in token files; with ``ids`` also their ids."""
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    # a row for each file, that is for each few million ids
    placed = manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(path)
        for batch in batches:
            for file, base in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist(), strict=True):
                with fs.open_input_stream(file, compression=None) as stream:
                    doc_ids, counts, all_ids = unpack(stream.read())
                ends = np.cumsum(counts)
                data = memoryview(np.ascontiguousarray(all_ids, "<u4")).cast("B")
                crc = [zlib.crc32(data[4 * s : 4 * e]) for s, e in zip((ends - counts).tolist(), ends.tolist(), strict=True)]
                columns = [pa.array(doc_ids), pa.array(base + ends - counts), pa.array(counts), pa.array(crc, pa.int64())]
                if ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(all_ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * ids)

    # a file takes seconds to decode; with a number of its own the deal isn't made coarser because a file's row is short
    readers = min(max(manifest.count(), 1), READERS)
    return placed.repartitionByRange(readers, "part", "seq").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * ids)


def stored(documents: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """Encodes documents, writes the token files in the shared folder and reads them back.

    Null texts are empty and have the end id alone; rows with a null id are left out; rows that repeat an id follow
    one another in the order of their texts. An empty table writes no file and gives an empty result.
    """
    path = new_path(documents.sparkSession, "tokens")
    return read_files(write_files(texts_of(documents, id_col, text_col), tokenizer_file, path), path, ids)
