"""Removal of repeated substrings: every byte in a string of 100 bytes that also starts earlier in the corpus.

A sparse suffix array over content-chosen anchors, sorted in buckets by deep-shallow sorting:

1. Anchors. Of the 69 strings of 32 bytes in any string of 100 bytes, those of the least hash are anchors; equal
   strings of 100 bytes hold equal anchors at equal places. About one position in 35 is an anchor. Anchors meet by the hash
   of their 32 bytes; one whose 32 bytes occur once in the corpus can't be in a repeat. An anchor that one task sees often is
   dealt out under a salt of its own.
2. Classes. Each anchor has a digest of the 68 bytes before and the 100 bytes from it. Of anchors that agree in all these,
   the strings around all but the first are repeats; the first goes on, where its 32 bytes have other classes or salts.
3. Buckets and sorting. In a bucket, the suffixes from the anchors, and the reversed texts before them, are sorted: multikey
   quicksort on words of eight bytes to a shallow depth, then a blind trie for each group that is still tied. Common prefix
   lengths of neighbours then give, for each of the 69 places of a string around its anchor, the classes of equal strings;
   all but the first of a class are repeats.
4. Salted buckets pass the strings that are first in their part on, as 128-bit digests, to one more minimum over all parts.
5. Documents equal to an earlier one are repeats as a whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import binary_column, dropped, freed, over_groups, ranges, text_buffer, texts_of, written
from flowlens.llm.shingles import chunks, mixed, powers

LENGTH = 100
ANCHOR = 32
#: places of an anchor in a string
PLACES = LENGTH - ANCHOR + 1
#: occurrences within one block of anchors from which an anchor gets a salt, and the share of the block that they are at least
OFTEN, SHARE = 256, 1 / 2000
SALTS = 1 << 16
BLOCK = 1_000_000
SHALLOW = {"right": 6, "left": 3}
_CODES = np.random.default_rng(31).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEPS = np.random.default_rng(37).integers(1, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def sliding(x: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """best over x[i : i + width] for every full window."""
    size = 1
    out = x
    while size * 2 <= width:
        out = best(out[:-size], out[size:])
        size *= 2
    rest = width - size
    return best(out[: len(out) - rest], out[rest:]) if rest else out


def anchor_hashes(data: np.ndarray) -> np.ndarray:
    """The hash of every string of 32 bytes."""
    h, size, step = _CODES[data], 1, 0
    while size < ANCHOR:
        h = h[:-size] * _STEPS[step] + h[size:]
        size, step = size * 2, step + 1
    return mixed(h)


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, hash) of the anchors in a stretch of bytes."""
    if len(data) < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = anchor_hashes(data)
    least = sliding(h, PLACES, np.minimum)
    # a place is an anchor if it is the least of one of the windows that hold it
    edge = np.zeros(PLACES - 1, np.uint64)
    highest = sliding(np.concatenate((edge, least, edge)), PLACES, np.maximum)
    at = np.flatnonzero(highest == h)
    return at, h[at]


def anchor_rows(documents: DataFrame, least: int = OFTEN) -> DataFrame:
    """(h, salt, c, doc_id, pos, right): c is a digest of what is around the anchor, right the bytes from its start, 100 at most.

    For each salted h a row without a position under salt 0 tells that h occurs elsewhere. A text that the task has had
    under a smaller id is left out: its own strings all start earlier there.
    """

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        had: dict[bytes, int] = {}
        held: list[tuple[np.ndarray, ...]] = []
        count = 0
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            ids = batch.column("doc_id").to_numpy()
            for s, e in chunks(offsets):
                use = np.zeros(e - s, bool)
                for i in range(s, e):
                    n = int(offsets[i + 1] - offsets[i])
                    if n >= LENGTH:
                        key = hashlib.blake2b(data[offsets[i] : offsets[i + 1]], digest_size=16).digest()
                        use[i - s] = had.get(key, ids[i] + 1) >= ids[i]
                        had[key] = min(int(ids[i]), had.get(key, int(ids[i])))
                text = data[offsets[s] : offsets[e]]
                pos, h = anchors(text)
                local = offsets[s : e + 1] - offsets[s]
                doc = np.searchsorted(local, pos, "right") - 1
                keep = use[doc] & (pos + ANCHOR <= local[doc + 1])
                pos, h, doc = pos[keep], h[keep], doc[keep]
                begin, end = np.maximum(pos - PLACES + 1, local[doc]), np.minimum(pos + LENGTH, local[doc + 1])
                up, down = powers(len(text) + 1)
                total = np.r_[np.zeros(1, np.uint64), np.cumsum(_CODES[text] * up[: len(text)])]
                c = mixed((total[end] - total[begin]) * down[begin] + (256 * (pos - begin) + end - pos).astype(np.uint64) * _STEPS[15])
                held.append((h, c, ids[s:e][doc], pos - local[doc], end - pos))
                count += len(pos)
                if count >= BLOCK:
                    yield tuple(map(np.concatenate, zip(*held, strict=True)))
                    held, count = [], 0
        if count:
            yield tuple(map(np.concatenate, zip(*held, strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, c, ids, pos, right in blocks(batches):
            values, of, counts = np.unique(h, return_inverse=True, return_counts=True)
            often = counts >= max(least, SHARE * len(h))
            # the salt follows from what the block holds, so that a repeated task deals alike
            salt = int(mixed(np.array([h[0] ^ np.uint64(len(h)) ^ np.uint64(ids[0] & 0x7FFFFFFF)]))[0] % np.uint64(SALTS - 1)) + 1
            hot = values[often].view(np.int64)
            none = np.zeros(len(hot), np.int64)
            columns = (np.r_[h.view(np.int64), hot], np.r_[np.where(often[of], salt, 0), none].astype(np.int32), np.r_[c.view(np.int64), none], np.r_[ids, none], np.r_[pos, none - 1].astype(np.int32), np.r_[right, none].astype(np.int32))
            for at in range(0, len(columns[0]), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[at : at + 50_000]) for x in columns], ["h", "salt", "c", "doc_id", "pos", "right"])

    packed = documents.mapInArrow(run, "h long, salt int, c long, doc_id long, pos int, right int")
    # one number for three makes the shuffled rows smaller
    return packed.select("h", "c", "doc_id", (F.shiftleft(F.col("pos").cast("long"), 24) + F.shiftleft("salt", 8) + F.col("right")).alias("p"), F.col("salt"))


def unpacked(p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pos, salt, right) of anchor_rows' p."""
    return p >> 24, p >> 8 & 0xFFFF, p & 0xFF


def repeated_anchors(rows: DataFrame) -> DataFrame:
    """(h, hot, doc_id, p) of the first anchor of each class whose h has other classes or other salts (hot); and, where h is null, (doc_id, s, e) of all the strings around the others."""

    def f(table: pa.Table) -> pa.RecordBatch | None:
        h, c, ids, p = (table[k].to_numpy() for k in ("h", "c", "doc_id", "p"))
        pos, salt, right = unpacked(p)
        starts = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (salt[1:] != salt[:-1])])
        sizes = np.diff(np.r_[starts, len(h)])
        group = np.repeat(np.arange(len(starts)), sizes)
        hot = (salt[starts] > 0) | np.logical_or.reduceat(pos < 0, starts)
        order = np.lexsort((pos, ids, c, group))
        order = order[pos[order] >= 0]
        g, k = group[order], c[order]
        first = np.r_[True, (g[1:] != g[:-1]) | (k[1:] != k[:-1])][: len(order)]
        classes = np.bincount(g[first], minlength=len(starts))
        go = order[first][(hot | (classes > 1))[g[first]]]
        again = order[~first]
        left = np.minimum(pos[again], PLACES - 1)
        again, left = again[left + right[again] >= LENGTH], left[left + right[again] >= LENGTH]
        if not len(go) + len(again):
            return None
        none, gone = pa.nulls(len(again), pa.int64()), pa.nulls(len(go), pa.int64())
        columns = [
            pa.concat_arrays([pa.array(h[go]), none]), pa.array(np.r_[hot[group[go]], np.zeros(len(again), bool)]), pa.array(np.r_[ids[go], ids[again]]),
            pa.concat_arrays([pa.array(p[go]), none]), pa.concat_arrays([gone, pa.array(pos[again] - left)]), pa.concat_arrays([gone, pa.array(pos[again] + right[again])]),
        ]
        return pa.RecordBatch.from_arrays(columns, ["h", "hot", "doc_id", "p", "s", "e"])

    return over_groups(rows, ["h", "salt"], f, "h long, hot boolean, doc_id long, p long, s long, e long", rows=200_000)


def contexts(documents: DataFrame, repeated: DataFrame) -> DataFrame:
    """(h, salt, hot, doc_id, pos, n_left, ctx): the bytes around each of the anchors (h, hot, doc_id, p), of which n_left are before it."""
    # the anchors of one document: their number is bounded by its length
    by_doc = repeated.groupBy("doc_id").agg(*[F.collect_list(c).alias(f"{c}s") for c in ("h", "hot", "p")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            ids = batch.column("doc_id").to_numpy()
            counts = np.asarray(batch.column("ps").value_lengths())
            bounds = np.r_[0, np.cumsum(counts)]
            flat = {c: batch.column(f"{c}s").flatten().to_numpy(zero_copy_only=False) for c in ("h", "hot", "p")}
            doc = np.repeat(np.arange(len(ids)), counts)
            for at in range(0, bounds[-1], 20_000):
                part = slice(at, min(at + 20_000, bounds[-1]))
                d, (pos, salt, _) = doc[part], unpacked(flat["p"][part])
                size = offsets[d + 1] - offsets[d]
                # rows that repeat an id with another text: anchors that aren't theirs don't fit
                fits = pos + ANCHOR <= size
                d, pos, size = d[fits], pos[fits], size[fits]
                left = np.minimum(pos, PLACES - 1)
                right = np.minimum(size - pos, LENGTH)
                text = data[ranges(offsets[d] + pos - left, left + right)]
                columns = [flat["h"][part][fits], salt[fits].astype(np.int32), flat["hot"][part][fits], ids[d], pos.astype(np.int32), left.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), binary_column(text, np.r_[0, np.cumsum(left + right)])], ["h", "salt", "hot", "doc_id", "pos", "n_left", "ctx"])

    return documents.join(by_doc, "doc_id").mapInArrow(run, "h long, salt int, hot boolean, doc_id long, pos int, n_left int, ctx binary")


def own_places(data: np.ndarray, begin: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) of the places at which each anchor has the least hash of a string; data[begin + left] is where it starts."""
    if len(data) < ANCHOR or not len(begin):
        return np.zeros(len(begin), np.int64), np.zeros(len(begin), np.int64)
    h = anchor_hashes(data)
    lows, highs = [], []
    for at in range(0, len(begin), 20_000):
        b, l, r = begin[at : at + 20_000], left[at : at + 20_000], right[at : at + 20_000]
        mine = h[b + l]
        step = np.arange(1, PLACES)
        # how far it is to a lesser hash on either side
        before = (h[np.maximum((b + l)[:, None] - step, 0)] < mine[:, None]) & (step <= l[:, None])
        after = (h[np.minimum(b[:, None] + l[:, None] + step, len(h) - 1)] < mine[:, None]) & (step + ANCHOR <= r[:, None])
        a = np.where(before.any(1), before.argmax(1) + 1, PLACES)
        k = np.where(after.any(1), after.argmax(1) + 1, PLACES)
        lows.append(PLACES - k)
        highs.append(a - 1)
    return np.concatenate(lows), np.concatenate(highs)


def multikey_quicksort(words: np.ndarray, group: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, tied): rows of each group (a sorted column of numbers) in the order of their first ``depth`` words.

    All segments take a step at once: the middle row's word at the segment's depth is the pivot, and rows fall into
    less, equal and greater; only the equal part goes on to the next word. tied numbers the segments that are
    equal in all the words.
    """
    n = len(group)
    order = np.arange(n)
    segment = np.cumsum(np.r_[False, group[1:] != group[:-1]]) if n else np.zeros(0, np.int64)
    level = np.zeros(n, np.int64)
    while True:
        starts = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]]) if n else np.zeros(0, np.int64)
        sizes = np.diff(np.r_[starts, n])
        active = np.repeat(sizes > 1, sizes) & (level < depth)
        rows = np.flatnonzero(active)
        if not len(rows):
            return order, segment
        which = np.repeat(np.arange(len(starts)), sizes)[rows]
        middle = starts + sizes // 2
        value = words[order[rows], level[rows]]
        pivot = words[order[middle], np.minimum(level[middle], depth - 1)][which]
        side = (value > pivot).astype(np.int64) - (value < pivot) + 1
        place = np.argsort(segment[rows] * 3 + side, kind="stable")
        order[rows] = order[rows][place]
        level[rows] = (level[rows] + (side == 1))[place]
        key = segment * 3
        key[rows] += side[place]
        segment = np.cumsum(np.r_[False, key[1:] != key[:-1]])


def blind_trie(strings: list[bytes]) -> list[int]:
    """The sorted order of strings of one length.

    An inner node holds the place where its strings first differ and a child for each byte there; a descent looks at
    those bytes alone, and one comparison with the leaf that it reaches tells where the new string branches off.
    Equal strings share a leaf.
    """
    size = len(strings[0])
    root: list | tuple = [0]
    for i in range(1, len(strings)):
        s, node = strings[i], root
        while type(node) is tuple:
            children = node[1]
            node = children.get(s[node[0]]) or next(iter(children.values()))
        t = strings[node[0]]
        if s == t:
            node.append(i)
            continue
        differs = size - 1 - ((int.from_bytes(s, "big") ^ int.from_bytes(t, "big")).bit_length() - 1) // 8
        above, node = None, root
        while type(node) is tuple and node[0] < differs:
            above, node = node, node[1][s[node[0]]]
        if type(node) is tuple and node[0] == differs:
            node[1][s[differs]] = [i]
            continue
        inner = (differs, {t[differs]: node, s[differs]: [i]})
        if above is None:
            root = inner
        else:
            above[1][s[above[0]]] = inner
    out: list[int] = []
    stack = [root]
    while stack:
        node = stack.pop()
        if type(node) is list:
            out += node
        else:
            stack.extend(node[1][b] for b in sorted(node[1], reverse=True))
    return out


def deep_shallow(matrix: np.ndarray, group: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, common): the rows of each group in sorted order, and the bytes each shares with the row before it; -1 where a group starts."""
    n, width = matrix.shape
    padded = np.zeros((n, -(-width // 8) * 8), np.uint8)
    padded[:, :width] = matrix
    order, tied = multikey_quicksort(padded.view(">u8").astype(np.uint64), group, depth)
    starts = np.flatnonzero(np.r_[True, tied[1:] != tied[:-1]])
    sizes = np.diff(np.r_[starts, n])
    for s, m in zip(starts[sizes > 1].tolist(), sizes[sizes > 1].tolist(), strict=True):
        rows = order[s : s + m]
        text = matrix[rows].tobytes()
        order[s : s + m] = rows[blind_trie([text[k * width : (k + 1) * width] for k in range(m)])]
    common = np.full(n, -1)
    for s in range(1, n, 50_000):
        a, b = order[s - 1 : min(s + 49_999, n - 1)], order[s : s + 50_000]
        differs = matrix[a] != matrix[b]
        common[s : s + len(b)] = np.where(differs.any(1), differs.argmax(1), width)
        common[s : s + len(b)][group[a] != group[b]] = -1
    return order, common


def repeats(table: pa.Table) -> pa.RecordBatch | None:
    """(doc_id, s, e, w1, w2) of buckets: stretches that are repeats; and, where w1 is there, first strings of a part of a hot bucket."""
    table = table.combine_chunks()
    n = table.num_rows
    ids, pos, left, hot = (table[c].to_numpy(zero_copy_only=False) for c in ("doc_id", "pos", "n_left", "hot"))
    key = np.stack([table["h"].to_numpy(), table["salt"].to_numpy().astype(np.int64)], 1)
    group = np.cumsum(np.r_[False, (key[1:] != key[:-1]).any(1)])
    # in each bucket by place in the corpus
    place = np.lexsort((pos, ids, group))
    data, offsets = text_buffer(table["ctx"].chunk(0))
    begin, size = offsets[:-1][place], np.diff(offsets)[place]
    ids, pos, left, hot = ids[place], pos[place].astype(np.int64), left[place].astype(np.int64), hot[place]
    right = size - left
    after = np.zeros((n, LENGTH), np.uint8)
    after[np.repeat(np.arange(n), right), ranges(np.zeros(n, np.int64), right)] = data[ranges(begin + left, right)]
    before = np.zeros((n, PLACES - 1), np.uint8)
    back = ranges(np.zeros(n, np.int64), left)
    before[np.repeat(np.arange(n), left), back] = data[np.repeat(begin + left - 1, left) - back]
    order_r, common_r = deep_shallow(after, group, SHALLOW["right"])
    order_l, common_l = deep_shallow(before, group, SHALLOW["left"])
    covered = np.zeros((n, PLACES + 2), bool)
    first = np.zeros((n, PLACES), bool)
    class_r, class_l = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for o in range(PLACES):
        class_r[order_r] = np.cumsum(common_r < LENGTH - o)
        class_l[order_l] = np.cumsum(common_l < o)
        rows = np.flatnonzero((left >= o) & (right >= LENGTH - o))
        both = class_r[rows] * (n + 1) + class_l[rows]
        by = np.argsort(both, kind="stable")
        again = np.zeros(len(rows), bool)
        again[by[1:]] = both[by[1:]] == both[by[:-1]]
        covered[rows, o + 1] = again
        first[rows, o] = ~again
    row, start = np.nonzero(covered[:, 1:] & ~covered[:, :-1])
    _, end = np.nonzero(covered[:, :-1] & ~covered[:, 1:])
    # places start .. end - 1: the strings from pos - end + 1 to pos - start
    columns = [ids[row], pos[row] - end + 1, pos[row] - start + LENGTH]
    # a string goes by the anchor of its least hash; equal strings have the same
    some = np.flatnonzero(hot)
    low, high = own_places(data, begin[some], left[some], right[some])
    row, o = np.nonzero(first[some] & (np.arange(PLACES) >= low[:, None]) & (np.arange(PLACES) <= high[:, None]))
    row = some[row]
    w = np.zeros((2, len(row)), np.uint64)
    for at in range(0, len(row), 20_000):
        part = slice(at, at + 20_000)
        strings = data[(begin[row[part]] + left[row[part]] - o[part])[:, None] + np.arange(LENGTH)]
        words = np.zeros((len(strings), 104), np.uint8)
        words[:, :LENGTH] = strings
        words = words.view("<u8").astype(np.uint64)
        for k in range(2):
            total = np.zeros(len(words), np.uint64)
            for j in range(words.shape[1]):
                total = mixed(total * _STEPS[2 * k] + words[:, j] + _STEPS[j])
            w[k, part] = total
    if not len(columns[0]) and not len(row):
        return None
    none = len(columns[0])
    digest = [pa.concat_arrays([pa.nulls(none, pa.int64()), pa.array(x.view(np.int64))]) for x in w]
    return pa.RecordBatch.from_arrays([pa.array(np.r_[columns[0], ids[row]]), pa.array(np.r_[columns[1], pos[row] - o]), pa.array(np.r_[columns[2], pos[row] - o + LENGTH]), *digest], ["doc_id", "s", "e", "w1", "w2"])


def spans(documents: DataFrame, often: int = OFTEN) -> DataFrame:
    """(doc_id, s, e): stretches of bytes of (doc_id, text) that are repeats; they may overlap."""
    spark = documents.sparkSession
    digest = documents.select("doc_id", F.octet_length("text").cast("long").alias("n"), F.sha2(F.encode("text", "UTF-8"), 256).alias("digest")).where(F.col("n") >= LENGTH)
    source = digest.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1").select("digest", "first")
    copies = written(digest.join(source, "digest").where("doc_id <> first").select("doc_id", F.lit(0).cast("long").alias("s"), F.col("n").alias("e")), "copies")
    anchored = written(repeated_anchors(anchor_rows(documents, often)), "anchors")
    freed(spark)
    # a copy has no string that doesn't start earlier in its source
    sources = documents.join(copies.select("doc_id"), "doc_id", "left_anti")
    around = contexts(sources, anchored.where("h is not null").select("h", "hot", "doc_id", "p"))
    found = written(over_groups(around, ["h", "salt"], repeats, "doc_id long, s long, e long, w1 long, w2 long", rows=60_000), "repeats")
    sure = written(anchored.where("h is null").select("doc_id", "s", "e").unionByName(copies).unionByName(found.where("w1 is null").select("doc_id", "s", "e")), "stretches")
    dropped(anchored, copies)
    firsts = found.where("w1 is not null")
    least = firsts.groupBy("w1", "w2").agg(F.min(F.struct("doc_id", "s")).alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").select("w1", "w2", "least")
    late = firsts.join(least, ["w1", "w2"]).where(F.struct("doc_id", "s") != F.col("least"))
    return sure.unionByName(late.select("doc_id", "s", "e"))


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The maximal runs that stretches cover."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.r_[True, starts[1:] > ends[:-1]]
    return starts[new], ends[np.r_[np.flatnonzero(new)[1:] - 1, len(ends) - 1]]


def deduplicated(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", texts: bool = False, often: int = OFTEN) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256; with ``texts`` also kept, the remaining bytes.

    Null texts are empty; texts under 100 bytes lose nothing; rows with a null id are left out. Rows that repeat an
    id get a row each; equal ones share the first one's result. An empty table gives an empty result.
    """
    documents = texts_of(documents, id_col, text_col)
    by_doc = spans(documents, often).groupBy("doc_id").agg(F.collect_list("s").alias("ss"), F.collect_list("e").alias("es"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())] + [("kept", pa.binary())] * texts)
        for batch in batches:
            out = []
            for text, ss, es in zip(batch.column("text"), batch.column("ss"), batch.column("es"), strict=True):
                data = memoryview(text.as_buffer())
                digest, at, parts, removed, count = hashlib.sha256(), 0, [], 0, 0
                if ss.is_valid:
                    starts, ends = merged(*(np.minimum(x.values.to_numpy(), len(data)) for x in (ss, es)))
                    for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
                        parts.append(data[at:s])
                        removed, count, at = removed + e - s, count + (e > s), e
                parts.append(data[at:])
                for p in parts:
                    digest.update(p)
                out.append((len(data), removed, count, digest.hexdigest(), b"".join(parts) if texts else None))
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t.type) for c, t in zip(columns, list(kind)[1:], strict=False))], schema=kind)

    return documents.join(by_doc, "doc_id", "left").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * texts)
