"""Near-duplicate vectors: cross-polytope hashing after fast Hadamard rotations, multiprobe buckets, verified pairs."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import small_enough, whole_groups, written
from flowlens.llm.components import components

TABLES = 4
PROBES = 4
#: rows of a bucket above which it is dealt out as pairs of blocks
BLOCK = 4096
HOT_KEYS = 200_000


def vectors_of(column: pa.Array) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Row numbers and rows (double precision) of the usable vectors, by length: not null, of finite parts only, not zero."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.asarray(column.value_lengths().fill_null(0))
    flat = column.flatten()
    values = flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths)
    out: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for n in np.unique(lengths):
        if n:
            rows = np.flatnonzero(lengths == n)
            m = values[(ends[rows] - n)[:, None] + np.arange(n)]
            good = np.isfinite(m).all(1) & (m != 0).any(1)
            out[int(n)] = (rows[good], m[good])
    return out


def unit(m: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; the largest part is taken out first so that squares neither overflow nor vanish."""
    m = m / np.abs(m).max(1, keepdims=True)
    return m / np.sqrt((m * m).sum(1, keepdims=True))


def hadamard(m: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row; the row length is a power of two."""
    n, width = m.shape
    h = 1
    while h < width:
        m = m.reshape(n, width // (2 * h), 2, h)
        m = np.stack((m[:, :, 0] + m[:, :, 1], m[:, :, 0] - m[:, :, 1]), 2).reshape(n, width)
        h *= 2
    return m / math.sqrt(width)


def vertices(m: np.ndarray, table: int, seed: int) -> np.ndarray:
    """(n, PROBES) bucket numbers of a table, the row's own bucket first.

    Two rotations (three rounds of random signs and a Hadamard transform) each name the nearest signed axis;
    the probes also take the second nearest of the one, of the other and of both.
    """
    n, width = m.shape
    size = 1 << max(0, width - 1).bit_length()
    padded = np.zeros((n, size))
    padded[:, :width] = m
    axes = []
    for k in range(2):
        rng = np.random.default_rng([seed, table, k, size])
        x = padded
        for _ in range(3):
            x = hadamard(x * rng.choice([-1.0, 1.0], size))
        a = np.abs(x)
        first = a.argmax(1)
        a[np.arange(n), first] = -1
        second = a.argmax(1)
        axes.append([2 * i + (x[np.arange(n), i] < 0) for i in (first, second)])
    (p0, p1), (q0, q1) = axes
    base = 2 * size
    return np.stack([p0 * base + q0, p1 * base + q0, p0 * base + q1, p1 * base + q1], 1)[:, :PROBES]


def probe_rows(vectors: DataFrame, tables: int, seed: int) -> DataFrame:
    """A row for each vector, table and probe: bucket, own (the vector's own bucket), all bucket numbers and the vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, labels = batch.column("vec_id").to_numpy(), batch.column("label").to_numpy()
            for width, (rows, m) in vectors_of(batch.column("embedding")).items():
                for at in range(0, len(rows), 2000):
                    part, u = rows[at : at + 2000], unit(m[at : at + 2000])
                    n = len(part)
                    if not n:
                        continue
                    marks = np.concatenate([vertices(u, t, seed) for t in range(tables)], 1).astype(np.int32)
                    many = tables * PROBES
                    mixed = marks.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.repeat(np.arange(tables), PROBES).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
                    mixed += (labels[part].astype(np.int64).astype(np.uint64) * np.uint64(0xA0761D6478BD642F) + np.uint64(width * 0xE7037ED1A0B428DB & 0xFFFFFFFFFFFFFFFF))[:, None]
                    mixed ^= mixed >> np.uint64(29)
                    mixed *= np.uint64(0xBF58476D1CE4E5B9)
                    mixed ^= mixed >> np.uint64(32)
                    pick = np.repeat(np.arange(n), many)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(mixed.view(np.int64).ravel()),
                            pa.array(np.tile(np.arange(many) // PROBES, n).astype(np.int32)),
                            pa.array(np.tile(np.arange(many) % PROBES == 0, n)),
                            pa.array(ids[part][pick]),
                            pa.array(labels[part][pick].astype(np.int64)),
                            pa.FixedSizeListArray.from_arrays(pa.array(marks[pick].ravel()), many).cast(pa.list_(pa.int32())),
                            pa.FixedSizeListArray.from_arrays(pa.array(u[pick].astype(np.float64).ravel()), width).cast(pa.list_(pa.float64())),
                        ],
                        ["bucket", "tab", "own", "vec_id", "label", "marks", "unit"],
                    )

    return vectors.mapInArrow(run, "bucket long, tab int, own boolean, vec_id long, label long, marks array<int>, unit array<double>")


def pairs_of(group: dict[str, np.ndarray], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the linked pairs of a bucket that no earlier table shows; left rows are in their own bucket."""
    left, right = np.flatnonzero(group["left"]), np.flatnonzero(group["right"])
    found_a, found_b = [], []
    for at in range(0, len(left), 512):
        i = left[at : at + 512]
        a, b = np.nonzero(group["unit"][i] @ group["unit"][right].T >= threshold)
        a, b = i[a], right[b]
        keep = (group["vec_id"][a] != group["vec_id"][b]) & (group["label"][a] == group["label"][b])
        # where both are in their own bucket, the pair comes up from either side
        keep &= ~group["own"][b] | (group["vec_id"][a] < group["vec_id"][b])
        found_a.append(a[keep])
        found_b.append(b[keep])
    a, b = np.concatenate(found_a or [left[:0]]), np.concatenate(found_b or [left[:0]])
    if not len(a):
        return a, b
    tables, t = group["marks"].shape[1] // PROBES, group["tab"][a]
    shown = np.zeros(len(a), bool)
    for k in range(tables):
        x, y = group["marks"][a, k * PROBES : (k + 1) * PROBES], group["marks"][b, k * PROBES : (k + 1) * PROBES]
        shown |= (k < t) & ((x[:, :1] == y).any(1) | (y[:, :1] == x).any(1))
    # one's own bucket among the other's probes and the reverse, in the same table: the smaller id's bucket counts
    now_a = np.stack([group["marks"][a, t * PROBES + j] for j in range(PROBES)], 1)
    now_b = np.stack([group["marks"][b, t * PROBES + j] for j in range(PROBES)], 1)
    both = (now_a[:, :1] == now_b).any(1) & (now_b[:, :1] == now_a).any(1) & (now_a[:, 0] != now_b[:, 0])
    shown |= both & (group["vec_id"][a] > group["vec_id"][b])
    return a[~shown], b[~shown]


def linked_pairs(vectors: DataFrame, threshold: float = 0.98, tables: int = TABLES, seed: int = 7, block: int = BLOCK) -> DataFrame:
    """(a, b) with a < b for vectors (vec_id, embedding, label) of equal labels and a cosine of at least threshold.

    Rows with null id or label, and null, zero or non-finite vectors, link with nothing, nor do vectors of unlike
    lengths. Every pair that meets in a bucket is verified in double precision. A bucket of more than ``block``
    rows is dealt out as pairs of blocks, so that no task holds it and no pair is lost.
    """
    usable = vectors.select(F.col("vec_id").cast("long"), "embedding", F.col("label").cast("long")).where("vec_id is not null and label is not null and embedding is not null")
    rows = probe_rows(usable, tables, seed)
    # counts need no vectors
    hot = rows.groupBy("bucket").count().where(F.col("count") > block)
    hot = written(hot.select("bucket", F.ceil(F.col("count") / block).cast("int").alias("blocks")), "hot")
    side = F.broadcast(hot) if small_enough(hot, HOT_KEYS) else hot
    rows = rows.join(side, "bucket", "left").withColumn("mine", F.pmod(F.xxhash64("vec_id"), F.coalesce("blocks", F.lit(1))).cast("int"))
    each = F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)
    as_left = F.when(F.col("own"), F.transform(each, lambda j: F.struct(F.col("mine").alias("i"), j.alias("j"), F.lit(True).alias("left"), (j == F.col("mine")).alias("right"))))
    as_right = F.transform(F.filter(each, lambda i: ~(F.col("own") & (i == F.col("mine")))), lambda i: F.struct(i.alias("i"), F.col("mine").alias("j"), F.lit(False).alias("left"), F.lit(True).alias("right")))
    rows = rows.withColumn("cell", F.explode(F.concat(F.coalesce(as_left, F.array().cast("array<struct<i:int,j:int,left:boolean,right:boolean>>")), as_right))).select("bucket", "cell.*", "tab", "own", "vec_id", "label", "marks", "unit")
    keys = ["bucket", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, keys, 20_000):
            k = np.stack([table[c].to_numpy() for c in keys], 1)
            starts = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]).any(1)])
            sizes = np.diff(np.r_[starts, len(k)])
            left = np.r_[0, np.cumsum(table["left"].to_numpy())]
            a_ids, b_ids = [], []
            for s, n in zip(starts, sizes, strict=True):
                if n < 2 or left[s + n] == left[s]:
                    continue
                part = table.slice(s, n)
                group = {c: part[c].to_numpy() for c in ("left", "right", "own", "vec_id", "label", "tab")}
                for c in ("marks", "unit"):
                    flat = part[c].combine_chunks()
                    widths = np.asarray(flat.value_lengths())
                    if (widths != widths[0]).any():
                        raise ValueError("vectors of unlike lengths met in a bucket")
                    group[c] = flat.flatten().to_numpy().reshape(n, -1)
                a, b = pairs_of(group, threshold)
                a_ids.append(np.minimum(group["vec_id"][a], group["vec_id"][b]))
                b_ids.append(np.maximum(group["vec_id"][a], group["vec_id"][b]))
            if a_ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a_ids)), pa.array(np.concatenate(b_ids))], ["a", "b"])

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long").distinct()


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, tables: int = TABLES, seed: int = 7) -> DataFrame:
    """Per vector: vec_id, n_links, component_id (smallest id reachable by links) and kept (whether it is that id).

    Vectors without links are their own component; a row without an id keeps null there and isn't kept. Rows that
    repeat an id are one vertex, with a row each in the result. An empty table gives an empty result.
    """
    pairs = written(linked_pairs(vectors, threshold, tables, seed), "pairs")
    ends = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id")))
    links = ends.groupBy("id").agg(F.count(F.lit(1)).alias("links"))
    found = links.join(components(pairs), "id")
    out = vectors.select(F.col("vec_id").cast("long").alias("vec_id")).join(found, F.col("vec_id") == F.col("id"), "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
