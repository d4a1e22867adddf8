"""Exact top-k search by integer inner product: tiles of queries and shards, partial selection in each, lists merged by a tree."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: distinct queries and distinct candidates of a tile
TILE = 4096
#: rows of a tile's product that are in memory at a time
STRIP = 256
#: lists that a node of the merging tree joins
FAN = 16


def quantised(vectors: DataFrame, scale: int) -> DataFrame:
    """(vec_id, width, v): floor(scale * x) of the usable vectors, as bytes of int8 where all components fit, else of doubles; repeated rows once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("embedding")
            widths = np.asarray(column.value_lengths())
            flat = column.flatten().cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
            ends = np.cumsum(widths)
            for width in np.unique(widths):
                rows = np.flatnonzero(widths == width)
                with np.errstate(over="ignore", invalid="ignore"):
                    m = np.floor(scale * flat[(ends[rows] - width)[:, None] + np.arange(width)])
                finite = np.isfinite(m).all(1)
                rows, m = rows[finite], m[finite]
                small = (np.abs(m) <= 127).all(1)
                packed = np.empty(len(rows), object)
                packed[small] = [x.tobytes() for x in m[small].astype(np.int8)]
                packed[~small] = [x.tobytes() for x in m[~small]]
                yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(rows)), pa.array(np.full(len(rows), width, np.int32)), pa.array(packed, pa.binary())], ["vec_id", "width", "v"])

    usable = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where("vec_id is not null and embedding is not null")
    return usable.mapInArrow(run, "vec_id long, width int, v binary").distinct()


def unpacked(column: pa.ChunkedArray, width: int) -> np.ndarray:
    rows = column.to_pylist()
    out = np.zeros((len(rows), width))
    for i, v in enumerate(rows):
        out[i] = np.frombuffer(v, np.int8 if len(v) == width else np.float64)
    return out


def starts(ids: np.ndarray) -> np.ndarray:
    """Where each run of equal ids begins."""
    return np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])


def strip_top(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, ids, scores) of the k best other candidates of each query; both sides are sorted by id, and an id counts by its best row.

    The product is taken in single precision where that holds every sum exactly, else in double precision, else in whole numbers of any size.
    """
    of_query, of_candidate = starts(q_ids), starts(c_ids)
    ids, n = c_ids[of_candidate], len(of_candidate)
    bound = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(1, q.shape[1])
    if bound * n < 2**52:
        kind = np.float32 if bound < 2**24 else np.float64
        score = (q.astype(kind) @ c.astype(kind).T).astype(np.float64)
        if n < len(c_ids):
            score = np.maximum.reduceat(score, of_candidate, axis=1)
        if len(of_query) < len(q_ids):
            score = np.maximum.reduceat(score, of_query, axis=0)
        # one number for score and place, so that the selection settles ties by the smaller id
        key = score * n - np.arange(n)
        own = np.searchsorted(ids, q_ids[of_query]).clip(0, n - 1)
        mine = ids[own] == q_ids[of_query]
        key[mine, own[mine]] = -np.inf
        few = min(k, n)
        part = np.argpartition(-key, few - 1, axis=1)[:, :few] if few < n else np.tile(np.arange(n), (len(key), 1))
        for i, at in enumerate(of_query):
            pick = part[i][np.isfinite(key[i, part[i]])]
            yield int(q_ids[at]), ids[pick], score[i, pick].astype(np.int64)
        return
    whole = [[int(x) for x in row] for row in c]
    for at, end in zip(of_query, [*of_query[1:], len(q_ids)], strict=True):
        best: dict[int, int] = {}
        for row in q[at:end]:
            exact = [int(x) for x in row]
            for v, other in zip(c_ids.tolist(), whole, strict=True):
                if v != q_ids[at]:
                    best[v] = max(best.get(v, -(2**2200)), sum(a * b for a, b in zip(exact, other, strict=True)))
        top = heapq.nsmallest(k, ((-s, v) for v, s in best.items()))
        yield int(q_ids[at]), np.array([v for _, v in top], np.int64), np.array([min(max(-s, -(2**63)), 2**63 - 1) for s, _ in top], np.int64)


def merged(lists: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The k best of all lists (keys, vec_id, score) with equal keys, an id by its best score; rank from 1."""
    best = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
    once = lists.groupBy(*keys, "vec_id").agg(F.max("score").alias("score"))
    return once.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, scale: int = 64, tile: int = TILE) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest integer inner products with other vectors, ties to the smaller vec_id.

    vectors and queries are (vec_id, embedding); a component x counts as floor(scale * x) in double precision. Null ids, null
    vectors and vectors with null or non-finite components (before or after scaling) take no part; vectors of different
    lengths don't meet, empty ones score 0. Rows that repeat an id are one candidate, and one query, by their best score.
    A score beyond the range of a long is given as the end of that range, ranked as it is up to such ties. With fewer
    candidates than k all are returned, an empty table gives no rows, and columns beside the two are ignored.

    Both sides are dealt by a hash of id and vector into blocks of about ``tile`` rows; every pair of blocks is a tile, a matrix
    product whose best k a query go on. Lists then meet FAN at a time, level by level, so that no group grows with the table.
    """
    shards, asked = quantised(vectors, scale), quantised(queries, scale)
    n_shards, n_parts = (max(1, -(-df.count() // tile)) for df in (shards, asked))
    dealt = lambda n: F.pmod(F.xxhash64("vec_id", "v"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    shards = shards.withColumn("shard", dealt(n_shards)).withColumn("part", each(n_parts))
    asked = asked.withColumn("part", dealt(n_parts)).withColumn("shard", each(n_shards))

    def tops(candidates: pa.Table, wanted: pa.Table) -> pa.Table:
        out: list[tuple[int, np.ndarray, np.ndarray]] = []
        if candidates.num_rows and wanted.num_rows:
            width = candidates["width"][0].as_py()
            candidates, wanted = candidates.sort_by("vec_id"), wanted.sort_by("vec_id")
            c_ids, c = candidates["vec_id"].to_numpy(), unpacked(candidates["v"], width)
            q_ids, q = wanted["vec_id"].to_numpy(), unpacked(wanted["v"], width)
            for at in range(0, len(q_ids), STRIP):
                out += strip_top(q_ids[at : at + STRIP], q[at : at + STRIP], c_ids, c, k)
        sizes = [len(v) for _, v, _ in out]
        empty = [np.zeros(0, np.int64)]
        return pa.table(
            {
                "query_id": np.repeat(np.array([i for i, _, _ in out], np.int64), sizes),
                "node": np.full(sum(sizes), candidates["shard"][0].as_py() if out else 0, np.int32),
                "vec_id": np.concatenate([v for _, v, _ in out] or empty),
                "score": np.concatenate([s for _, _, s in out] or empty),
            }
        )

    keys = ["width", "shard", "part"]
    lists = shards.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(tops, "query_id long, node int, vec_id long, score long")
    while n_shards > FAN:
        n_shards = -(-n_shards // FAN)
        lists = merged(lists.withColumn("node", (F.col("node") / FAN).cast("int")), ["query_id", "node"], k).drop("rank")
    return merged(lists, ["query_id"], k).select("query_id", "rank", "vec_id", "score")
