"""N-gram Jaccard join of documents: rare-first prefixes with length, positional and suffix filters.

Two documents link when 100 * |intersection| >= percent * |union| of their sets of word shingles.

1. One pass over the texts gives each document's set size and a 128-bit digest of the set; the same pass counts shingles in
   ``COUNTERS`` shared counters (a table of fixed size), which order shingles from rare to frequent. Any common order is
   correct; a better one is faster.
2. Documents with equal sets are one class. Each task sends the prefix shingles of a set once.
3. Prefixes meet by shingle. First each document is verified against two others: of its neighbours in size and of the
   most famous members of its meetings, the ones it met most often. That settles most members of a group of copies
   with a pair or two each.
4. Then all pairs that met in a prefix, pass the length and positional filters there and whose members are in different
   components so far are taken, each once. So no link between components is lost, and a group of n copies of one
   document doesn't cost n * n pairs.
5. The suffix filter drops pairs whose sets differ in too many shingles: each set has a sketch of the parities of its counts
   in two to four times as many cells as it has shingles, and where two sketches differ, so do the sets. Rows of step 4 carry
   one of ``CELLS`` cells, which settles pairs of shorter texts before they are named. Each pair that is left is verified on
   the whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import binary_column, dropped, over_groups, small_enough, text_buffer, texts_of, whole_groups, written
from flowlens.llm.components import components
from flowlens.llm.shingles import chunks, mixed, shingle_sets

WIDTH = 5
PERCENT = 75
COUNTERS = 1 << 24
#: counters in a row
SEGMENT = 1 << 16
#: cells of the sketch that rows carry
CELLS = 1024
#: ids that may be broadcast (a few MB); more are joined by shuffling
SMALL = 200_000
#: members of a meeting, and rows of a family of meetings, that one task takes at a time; larger ones are split
BLOCK = 4096
FAMILY = 20_000


def needed(n1: np.ndarray, n2: np.ndarray, percent: int) -> np.ndarray:
    """The smallest intersection that links sets of these sizes."""
    return -(-percent * (n1 + n2) // (100 + percent))


def digests(documents: DataFrame, width: int) -> DataFrame:
    """A row (doc_id, n, d1, d2, sketch) for each document, and for each task rows (at, counts) of its shingle counters, a byte each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros(COUNTERS, np.uint16)
        kind = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("sketch", pa.binary()), ("at", pa.int32()), ("counts", pa.binary())])
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            for s, e in chunks(offsets):
                h, of = shingle_sets(data[offsets[s] : offsets[e]], offsets[s : e + 1] - offsets[s], width)
                cells, times = np.unique((h & np.uint64(COUNTERS - 1)).astype(np.int32), return_counts=True)
                counters[cells] = np.minimum(counters[cells] + times, 255)
                m = e - s
                n = np.bincount(of, minlength=m)
                d1, d2 = np.zeros(m, np.uint64), np.zeros(m, np.uint64)
                if len(h):
                    starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
                    d1[of[starts]] = np.add.reduceat(mixed(h + np.uint64(1)), starts)
                    d2[of[starts]] = np.add.reduceat(mixed(h ^ np.uint64(0x5851F42D4C957F2D)), starts)
                sketch = np.zeros((m, CELLS // 8), np.uint8)
                for at in range(0, m, 1024):
                    some = slice(*np.searchsorted(of, (at, at + 1024)))
                    odd = np.bincount((of[some] - at) * CELLS + (h[some] & np.uint64(CELLS - 1)).astype(np.int64), minlength=min(1024, m - at) * CELLS) & 1
                    sketch[at : at + 1024] = np.packbits(odd.astype(np.uint8).reshape(-1, CELLS), axis=1)
                sketches = binary_column(sketch.ravel(), np.arange(m + 1) * (CELLS // 8))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(s, m), pa.array(n), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), sketches, pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], schema=kind)
        none = pa.nulls(16, pa.int64())
        for at in range(0, COUNTERS, 16 * SEGMENT):
            part = counters[at : at + 16 * SEGMENT]
            if part.any():
                yield pa.RecordBatch.from_arrays([none, none, none, none, pa.nulls(16, pa.binary()), pa.array(at // SEGMENT + np.arange(16, dtype=np.int32)), binary_column(part.astype(np.uint8), np.arange(17) * SEGMENT)], schema=kind)

    return documents.mapInArrow(run, "doc_id long, n long, d1 long, d2 long, sketch binary, at int, counts binary")


def frequencies(counters: DataFrame) -> np.ndarray:
    """A byte for each counter, which grows with the logarithm of its sum over all tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = -1, np.zeros(SEGMENT, np.int64)

        def level() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([np.minimum(np.round(8 * np.log2(1 + total)), 255).astype(np.uint8).tobytes()], pa.binary())], ["at", "level"])

        for batch in batches:
            for k, counts in zip(batch.column("at").to_pylist(), batch.column("counts"), strict=True):
                if k != at:
                    if at >= 0:
                        yield level()
                    at, total = k, np.zeros(SEGMENT, np.int64)
                total += np.frombuffer(counts.as_buffer(), np.uint8)
        if at >= 0:
            yield level()

    out = np.zeros(COUNTERS, np.uint8)
    # COUNTERS bytes at most
    for row in counters.repartition("at").sortWithinPartitions("at").mapInArrow(run, "at int, level binary").toLocalIterator():
        out[row["at"] * SEGMENT : (row["at"] + 1) * SEGMENT] = np.frombuffer(row["level"], np.uint8)
    return out


def prefixes(documents: DataFrame, frequency: np.ndarray, width: int, percent: int) -> DataFrame:
    """(h, doc_id, n, pos): the prefix shingles of each set, once for each task that has it; pos is the rank in the set, rare first."""
    shared = documents.sparkSession.sparkContext.broadcast(frequency)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[tuple[int, int]] = set()
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            ids = batch.column("doc_id").to_numpy()
            for s, e in chunks(offsets):
                h, of = shingle_sets(data[offsets[s] : offsets[e]], offsets[s : e + 1] - offsets[s], width)
                if not len(h):
                    continue
                order = np.lexsort((h, shared.value[(h & np.uint64(COUNTERS - 1)).astype(np.int64)], of))
                starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
                n = np.diff(np.r_[starts, len(of)])
                digest = zip(n.tolist(), np.add.reduceat(mixed(h + np.uint64(1)), starts).tolist(), np.add.reduceat(mixed(h ^ np.uint64(0x5851F42D4C957F2D)), starts).tolist(), strict=True)
                fresh = np.zeros(len(n), bool)
                for i, d in enumerate(digest):
                    if d not in sent:
                        sent.add(d)
                        fresh[i] = True
                pos = np.arange(len(h)) - np.repeat(starts, n)
                keep = (pos <= np.repeat(n - needed_alone(n, percent), n)) & np.repeat(fresh, n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h[order].view(np.int64)[keep]), pa.array(ids[s:e][of][keep]), pa.array(np.repeat(n, n)[keep].astype(np.int32)), pa.array(pos[keep].astype(np.int32))],
                    ["h", "doc_id", "n", "pos"],
                )

    return documents.mapInArrow(run, "h long, doc_id long, n int, pos int")


def needed_alone(n: np.ndarray, percent: int) -> np.ndarray:
    """The smallest intersection that a set of this size can link with."""
    return -(-percent * n // 100)


def may_link(n1: np.ndarray, n2: np.ndarray, p1: np.ndarray, p2: np.ndarray, percent: int) -> np.ndarray:
    """Length and positional filters for sets that share the shingle at these ranks."""
    alike = np.minimum(n1, n2) * 100 >= percent * np.maximum(n1, n2)
    return alike & (np.minimum(p1, p2) + 1 + np.minimum(n1 - p1, n2 - p2) - 1 >= needed(n1, n2, percent))


def meetings(prefix: DataFrame, percent: int) -> DataFrame:
    """The prefix rows of shingles that several documents share: size is their number, prev the next smaller member, where the pair may link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["h"], 200_000):
            h, ids, n, pos = (table[c].to_numpy() for c in ("h", "doc_id", "n", "pos"))
            same = np.r_[False, h[1:] == h[:-1]]
            several = same | np.r_[same[1:], False]
            prev = np.r_[0, ids[:-1]]
            starts = np.flatnonzero(~same)
            size = np.repeat(np.diff(np.r_[starts, len(h)]), np.diff(np.r_[starts, len(h)]))
            n, pos = n.astype(np.int64), pos.astype(np.int64)
            good = same & (prev != ids) & may_link(n, np.r_[1, n[:-1]], pos, np.r_[0, pos[:-1]], percent)
            if several.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h[several]), pa.array(ids[several]), pa.array(n[several].astype(np.int32)), pa.array(pos[several].astype(np.int32)), pa.array(prev[several], mask=~good[several]), pa.array(size[several].astype(np.int32))],
                    ["h", "doc_id", "n", "pos", "prev", "size"],
                )

    return prefix.repartition("h").sortWithinPartitions("h", "n", "doc_id").mapInArrow(run, "h long, doc_id long, n int, pos int, prev long, size int")


def hub_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """(doc_id, prev): for each row of (h, doc_id, n, pos, fame) the most famous member of its group, where the pair may link.

    Fame is how many meetings a document's prefix brings. A document that others were copied from keeps all the
    shingles that its copies share, so that it is the most famous among them.
    """

    def f(table: pa.Table) -> pa.RecordBatch | None:
        h, ids, n, pos, fame = (table[c].to_numpy() for c in ("h", "doc_id", "n", "pos", "fame"))
        n, pos = n.astype(np.int64), pos.astype(np.int64)
        group = np.cumsum(np.r_[False, h[1:] != h[:-1]])
        order = np.lexsort((ids, -fame, group))
        hub = order[np.flatnonzero(np.r_[True, group[order][1:] != group[order][:-1]])][group]
        keep = (ids[hub] != ids) & may_link(n, n[hub], pos, pos[hub], percent)
        return pa.RecordBatch.from_arrays([pa.array(ids[keep]), pa.array(ids[hub][keep])], ["doc_id", "prev"])

    return over_groups(rows, ["h"], f, "doc_id long, prev long", rows=200_000)


def mixed_groups(rows: DataFrame, percent: int) -> DataFrame:
    """The rows of (h, doc_id, n, pos, label) whose h occurs under several labels, but for pairs that can't link.

    size is the number of the group's rows; family, its least doc_id, is often the same for the groups that two documents share.
    """

    def f(table: pa.Table) -> pa.RecordBatch | None:
        h, label = table["h"].to_numpy(), table["label"].to_numpy()
        starts = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        sizes = np.diff(np.r_[starts, len(h)])
        differs = np.minimum.reduceat(label, starts) != np.maximum.reduceat(label, starts)
        two = np.flatnonzero(sizes == 2)
        n, pos = table["n"].to_numpy().astype(np.int64), table["pos"].to_numpy().astype(np.int64)
        x, y = starts[two], starts[two] + 1
        differs[two] &= may_link(n[x], n[y], pos[x], pos[y], percent)
        family = np.minimum.reduceat(table["doc_id"].to_numpy(), starts)
        table = table.append_column("family", pa.array(np.repeat(family, sizes))).append_column("size", pa.array(np.repeat(sizes, sizes)))
        out = table.filter(pa.array(np.repeat(differs, sizes))).combine_chunks()
        return out.to_batches()[0] if out.num_rows else None

    return over_groups(rows.select("h", "doc_id", "n", "pos", "label"), ["h"], f, "h long, doc_id long, n int, pos int, label long, family long, size long", rows=200_000)


def crossing_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b), a < b: pairs of (h, doc_id, n, pos, label, family, size, sketch) that share h, differ in label and pass length and positional filters and that of the sketches, where both have one.

    Groups of one family are dealt to one task, which names a pair once. Families of many rows are dealt out by h, and
    the groups of more than BLOCK members by pairs of their blocks.
    """
    many = rows.groupBy("family").count().where(F.col("count") > FAMILY).select("family", F.ceil(F.col("count") / FAMILY).alias("shards"))
    # as many rows as FAMILY goes into all rows, at most
    rows = rows.join(F.broadcast(many) if small_enough(many, SMALL) else many, "family", "left")
    parts = F.ceil(F.col("size") / BLOCK)
    block = F.pmod(F.xxhash64("doc_id"), parts).cast("int")
    dealt = rows.select("h", "doc_id", "n", "pos", "label", "sketch", "family", F.pmod(F.xxhash64("h"), F.coalesce("shards", F.lit(1))).alias("shard"), block.alias("block"), F.explode(F.sequence(F.lit(0), (parts - 1).cast("int"))).alias("other"))
    dealt = dealt.select("h", "doc_id", "n", "pos", "label", "sketch", "family", "shard", "block", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"))
    keys = ["family", "shard", "x", "y"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, keys, 100_000):
            h, ids, n, pos, label, block, x, y = (table[c].to_numpy() for c in ("h", "doc_id", "n", "pos", "label", "block", "x", "y"))
            n, pos = n.astype(np.int64), pos.astype(np.int64)
            sketch = table["sketch"].combine_chunks()
            sketched = np.asarray(sketch.is_valid())
            sketch = text_buffer(sketch.fill_null(bytes(CELLS // 8)))[0].reshape(-1, CELLS // 8).view(np.uint64)
            group = np.cumsum(np.r_[False, (h[1:] != h[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
            found = np.zeros((0, 2), np.int64)
            held: list[np.ndarray] = []
            # each row with the next of its group, then the one after; by size, so that a row is done when they grow too long for it
            i, step, count = np.arange(len(h)), 1, 0
            while len(i):
                i = i[: np.searchsorted(i, len(h) - step)]
                i = i[(group[i] == group[i + step]) & (n[i] * 100 >= percent * n[i + step])]
                j = i + step
                ok = (label[i] != label[j]) & (ids[i] != ids[j]) & ((x[i] == y[i]) | (block[i] != block[j])) & may_link(n[i], n[j], pos[i], pos[j], percent)
                for at in range(0, int(ok.sum()), 50_000):
                    u, v = i[ok][at : at + 50_000], j[ok][at : at + 50_000]
                    apart = np.bitwise_count(sketch[u] ^ sketch[v]).sum(1, dtype=np.int64) * (sketched[u] & sketched[v])
                    near = apart <= n[u] + n[v] - 2 * needed(n[u], n[v], percent)
                    held.append(np.stack([np.minimum(ids[u[near]], ids[v[near]]), np.maximum(ids[u[near]], ids[v[near]])], 1))
                    count += len(held[-1])
                step += 1
                if count > 1_000_000:
                    found, held, count = np.unique(np.concatenate([found, *held]), axis=0), [], 0
            found = np.unique(np.concatenate([found, *held]), axis=0)
            for at in range(0, len(found), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(found[at : at + 100_000, k]) for k in range(2)], ["a", "b"])

    return dealt.repartition(*keys).sortWithinPartitions(*keys, "h", "n").mapInArrow(run, "a long, b long").distinct()


def chosen(documents: DataFrame, pairs: DataFrame) -> DataFrame:
    """The documents that occur in pairs."""
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id"))).distinct()
    return documents.join(F.broadcast(ids) if small_enough(ids, SMALL) else ids, "doc_id", "left_semi")


def parities(h: np.ndarray) -> bytes:
    """Whether an odd number of the shingles falls into each cell; the cells are a power of two."""
    cells = 1 << max(6, int(2 * len(h) - 1).bit_length())
    return np.packbits(np.bincount((h & np.uint64(cells - 1)).astype(np.int64), minlength=cells).astype(np.uint8) & 1, bitorder="little").tobytes()


def differing(x: bytes, y: bytes) -> int:
    """How many shingles two sets don't share, at the least."""
    x, y = sorted((np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)), key=len)
    y = np.bitwise_xor.reduce(y.reshape(-1, len(x)), 0)
    return int(np.bitwise_count(x ^ y).sum())


def after_suffix_filter(pairs: DataFrame, documents: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs whose sketches allow the needed intersection, written."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            for s, e in chunks(offsets):
                h, of = shingle_sets(data[offsets[s] : offsets[e]], offsets[s : e + 1] - offsets[s], width)
                sets = np.split(h, np.searchsorted(of, np.arange(1, e - s)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(s, e - s), pa.array([len(x) for x in sets], pa.int64()), pa.array([parities(x) for x in sets], pa.binary())], ["doc_id", "n", "sketch"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n1, n2 = (batch.column(f"n_{x}").to_numpy() for x in "ab")
            apart = np.array([differing(x.as_buffer(), y.as_buffer()) for x, y in zip(batch.column("sketch_a"), batch.column("sketch_b"), strict=True)], np.int64)
            yield batch.select(["a", "b"]).filter(pa.array(apart <= n1 + n2 - 2 * needed(n1, n2, percent)))

    sketches = written(chosen(documents, pairs).mapInArrow(sketch, "doc_id long, n long, sketch binary"), "sketches")
    side = lambda x: sketches.select(F.col("doc_id").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"sketch_{x}"))
    out = written(pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b").mapInArrow(run, "a long, b long"), "filtered-pairs")
    dropped(sketches)
    return out


def verified(pairs: DataFrame, documents: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs whose whole sets link, written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [text_buffer(batch.column(c)) for c in ("text_a", "text_b")]
            for s, e in chunks(sides[0][1] + sides[1][1]):
                sets = [shingle_sets(data[offsets[s] : offsets[e]], offsets[s : e + 1] - offsets[s], width) for data, offsets in sides]
                h, of = (np.concatenate(c) for c in zip(*sets, strict=True))
                order = np.lexsort((h, of))
                h, of = h[order], of[order]
                same = np.bincount(of[1:][(h[1:] == h[:-1]) & (of[1:] == of[:-1])], minlength=e - s)
                total = np.bincount(of, minlength=e - s)
                yield batch.slice(s, e - s).select(["a", "b"]).filter(pa.array((same > 0) & (100 * same >= percent * (total - same))))

    texts = chosen(documents, pairs)
    side = lambda x: texts.select(F.col("doc_id").alias(x), F.col("text").alias(f"text_{x}"))
    return written(pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long"), "links")


def join_components(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (the smallest doc_id reachable by links, itself included).

    Null and empty texts have no shingle and link with nothing. Rows with a null id are left out; rows that repeat
    an id are one vertex and get a row each. An empty table gives an empty result.
    """
    spark = documents.sparkSession
    documents = texts_of(documents, id_col, text_col)
    seen = written(digests(documents, width), "digests")
    sizes = seen.where("doc_id is not null").select("doc_id", "n", "d1", "d2", "sketch")
    frequency = frequencies(seen.where("at is not null").select("at", "counts"))

    classes = sizes.where("n > 0").groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("rep"))
    members = written(sizes.drop("sketch").join(classes, ["n", "d1", "d2"], "left").select("doc_id", "n", F.coalesce("rep", "doc_id").alias("rep")), "members")
    of_class = members.groupBy("doc_id").agg(F.min("rep").alias("rep"))

    met = written(meetings(prefixes(documents, frequency, width, percent), percent), "meetings")
    most = lambda df: df.groupBy("doc_id", "prev").count().groupBy("doc_id").agg(F.max_by("prev", F.struct("count", F.negative("prev"))).alias("prev"))
    fame = written(met.groupBy("doc_id").agg(F.sum("size").alias("fame")), "fame")
    few = small_enough(fame, SMALL)
    famous = met.select("h", "doc_id", "n", "pos").join(F.broadcast(fame) if few else fame, "doc_id")
    partners = most(met.where("prev is not null").select("doc_id", "prev")).union(most(hub_pairs(famous, percent)))
    # a is the one that has few partners, b may have many
    pairs = partners.groupBy(F.least("doc_id", "prev"), F.greatest("doc_id", "prev")).agg(F.max(F.struct("doc_id", "prev")).alias("p"))
    first = written(pairs.select(F.col("p.doc_id").alias("a"), F.col("p.prev").alias("b")), "first-pairs")
    dropped(fame)
    close = after_suffix_filter(first, documents, width, percent)
    linked = verified(close, documents, width, percent)
    dropped(close)

    def by_class(pairs: DataFrame) -> DataFrame:
        out = pairs.join(of_class.select(F.col("doc_id").alias("a"), F.col("rep").alias("u")), "a").join(of_class.select(F.col("doc_id").alias("b"), F.col("rep").alias("v")), "b")
        return out.select(F.col("u").alias("a"), F.col("v").alias("b")).where("a <> b").distinct()

    so_far = components(by_class(linked))
    label = written(met.select("doc_id").distinct().join(of_class, "doc_id").join(so_far, F.col("rep") == F.col("id"), "left").select("doc_id", F.coalesce("component_id", "rep").alias("label")), "labels")
    rest = met.select("h", "doc_id", "n", "pos").join(F.broadcast(label) if few else label, "doc_id")
    mixed_rows = written(mixed_groups(rest, percent), "mixed-groups")
    dropped(met, label)
    tried = first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    # texts that share an id have no common sketch
    sketches = sizes.groupBy("doc_id").agg(F.min("sketch").alias("sketch"), F.max("sketch").alias("other")).select("doc_id", F.when(F.col("sketch") == F.col("other"), F.col("sketch")).alias("sketch"))
    second = written(crossing_pairs(mixed_rows.join(sketches, "doc_id"), percent).join(tried, ["a", "b"], "left_anti"), "second-pairs")
    dropped(mixed_rows, first, seen)
    close = after_suffix_filter(second, documents, width, percent)
    more = verified(close, documents, width, percent)
    dropped(second, close)
    found = so_far if more.isEmpty() else components(by_class(linked.union(more)))
    out = members.join(found, F.col("rep") == F.col("id"), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "rep").alias("component_id"))


def one_of_each(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of documents whose id is the smallest of its component, with all their columns; rows without an id stay."""
    others = join_components(documents, id_col, text_col).where("doc_id <> component_id").select(F.col("doc_id").alias("_id")).distinct()
    return documents.join(others, F.col(id_col).cast("long") == F.col("_id"), "left_anti")
