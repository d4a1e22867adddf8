"""Approximate nearest neighbours: an inverted multi-index over two vector halves."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlens.llm.embed_dedup import unit, vectors_of

#: vectors that the codebooks are fitted on, at most
SAMPLE = 20_000
CENTROIDS = 16
#: share of all vectors whose cells a query visits, and the least number of them
SHARE, LEAST = 0.6, 2000
#: entries of a cell that one task ranks
BLOCK = 20_000


def k_means(m: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    """Lloyd's rounds from k rows drawn with a fixed seed; fewer rows than k give as many centroids."""
    rng = np.random.default_rng(seed)
    m = np.unique(m, axis=0)
    centroids = m[rng.permutation(len(m))[:k]].copy()
    for _ in range(rounds):
        nearest = half_distances(m, centroids).argmin(1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, m)
        counts = np.bincount(nearest, minlength=len(centroids))
        centroids[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centroids


def half_distances(m: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return (m * m).sum(1)[:, None] - 2 * m @ centroids.T + (centroids * centroids).sum(1)[None]


def nearest_cells(d1: np.ndarray, d2: np.ndarray, counts: np.ndarray, wanted: int) -> list[int]:
    """Cells in the order of summed half distances until they hold the wanted number of entries: the multi-sequence walk."""
    o1, o2 = d1.argsort(kind="stable"), d2.argsort(kind="stable")
    heap, pushed, got, out = [(d1[o1[0]] + d2[o2[0]], 0, 0)], {(0, 0)}, 0, []
    while heap and got < wanted:
        _, i, j = heapq.heappop(heap)
        cell = int(o1[i]) * len(d2) + int(o2[j])
        if counts[cell]:
            out.append(cell)
            got += counts[cell]
        for x, y in ((i + 1, j), (i, j + 1)):
            # a pair comes up once both its predecessors have been taken
            if x < len(o1) and y < len(o2) and (x, y) not in pushed and (x == 0 or (x - 1, y) in pushed) and (y == 0 or (x, y - 1) in pushed):
                pushed.add((x, y))
                heapq.heappush(heap, (d1[o1[x]] + d2[o2[y]], x, y))
    return out


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, sample: int = SAMPLE, centroids: int = CENTROIDS, share: float = SHARE, least: int = LEAST, seed: int = 11) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest found among the other vectors by cosine in double precision.

    vectors and queries are (vec_id, embedding). Rows that repeat an id are one candidate, and one query, by the best of their
    scores. Null ids and null, zero or non-finite vectors take
    no part, nor do vectors of a length other than the commonest in the sample. Ties go to the smaller vec_id; with
    fewer than k candidates all are returned; an empty table gives an empty result. The two codebooks are fitted on
    at most ``sample`` vectors, drawn by a hash of the id; every vector is indexed. A query visits cells until they
    hold max(least, share of all) entries; then all their entries are ranked on the original vectors.
    """
    spark = vectors.sparkSession
    vectors = vectors.select(F.col("vec_id").cast("long"), "embedding").where("vec_id is not null and embedding is not null")
    queries = queries.select(F.col("vec_id").cast("long"), "embedding").where("vec_id is not null and embedding is not null")
    schema = "query_id long, rank int, vec_id long, score double"
    fit = vectors.orderBy(F.xxhash64("vec_id", F.lit(seed)), "vec_id").limit(sample).toArrow()
    by_width = {w: m for w, (_, m) in vectors_of(fit["embedding"]).items() if len(m)} if fit.num_rows else {}
    if not by_width:
        return spark.createDataFrame([], schema)
    width = max(by_width, key=lambda w: (len(by_width[w]), w))
    u = unit(by_width[width])
    half = (width + 1) // 2
    books = [k_means(u[:, :half], centroids, seed), k_means(u[:, half:], centroids, seed + 1) if width > half else np.zeros((1, 0))]
    cells = len(books[0]) * len(books[1])

    def used(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        rows, m = vectors_of(batch.column("embedding")).get(width, (np.zeros(0, np.int64), np.zeros((0, width))))
        scaled = unit(m) if len(m) else m
        return batch.column("vec_id").to_numpy()[rows], m, [half_distances(scaled[:, :half], books[0]), half_distances(scaled[:, half:], books[1])]

    def packed(cell: np.ndarray, ids: np.ndarray, m: np.ndarray) -> pa.RecordBatch:
        flat = pa.FixedSizeListArray.from_arrays(pa.array(m.ravel()), width).cast(pa.list_(pa.float64()))
        return pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(ids), flat], ["cell", "id", "v"])

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, m, (d1, d2) = used(batch)
            if len(ids):
                yield packed(d1.argmin(1) * len(books[1]) + d2.argmin(1), ids, m)

    entries = vectors.mapInArrow(index, "cell int, id long, v array<double>")
    # at most centroids ** 2 rows
    counts = np.zeros(cells, np.int64)
    for row in entries.groupBy("cell").count().collect():
        counts[row[0]] = row[1]
    wanted = max(least, int(share * counts.sum()))
    blocks = np.maximum(1, -(-counts // BLOCK))

    def routes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, m, (d1, d2) = used(batch)
            for at in range(0, len(ids), 64):
                visited = [nearest_cells(d1[i], d2[i], counts, wanted) for i in range(at, min(at + 64, len(ids)))]
                pick = np.repeat(np.arange(at, at + len(visited)), [len(x) for x in visited])
                if len(pick):
                    yield packed(np.concatenate([np.array(x, np.int64) for x in visited]), ids[pick], m[pick])

    block_of = F.element_at(F.array(*[F.lit(int(b)) for b in blocks]), F.col("cell") + 1)
    entries = entries.withColumn("block", F.pmod(F.xxhash64("id"), block_of).cast("int"))
    asked = queries.mapInArrow(routes, "cell int, id long, v array<double>").withColumn("block", F.explode(F.sequence(F.lit(0), block_of - 1)))

    def matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        return table["id"].to_numpy(), table["v"].combine_chunks().flatten().to_numpy().reshape(-1, width)

    def ranked(entry: pa.Table, query: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], []]
        if entry.num_rows and query.num_rows:
            (e_ids, e), (q_ids, q) = matrix(entry), matrix(query)
            order = e_ids.argsort(kind="stable")
            e_ids, e = e_ids[order], unit(e[order])
            # rows of one id count once, so that as many more have to be looked at
            most = int(np.diff(np.r_[np.flatnonzero(np.r_[True, e_ids[1:] != e_ids[:-1]]), len(e_ids)]).max())
            for at in range(0, len(q_ids), 256):
                ids = q_ids[at : at + 256]
                score = unit(q[at : at + 256]) @ e.T
                score[ids[:, None] == e_ids[None]] = -np.inf
                few = min(k * most, len(e_ids))
                # every entry that ties with the k-th comes along; the final ranking settles it
                least_score = -np.partition(-score, few - 1, 1)[:, few - 1]
                i, j = np.nonzero((score >= least_score[:, None]) & np.isfinite(score))
                place = np.lexsort((e_ids[j], -score[i, j], i))
                i, j = i[place], j[place]
                if most > 1:
                    once = np.sort(np.unique(np.stack([i, e_ids[j]]), axis=1, return_index=True)[1])
                    i, j = i[once], j[once]
                first = np.r_[0, np.cumsum(np.bincount(i, minlength=len(ids)))][:-1]
                keep = np.arange(len(i)) - first[i] < k
                for column, x in zip(out, (ids[i], e_ids[j], score[i, j]), strict=True):
                    column.append(x[keep])
        return pa.table([np.concatenate(out[0] or [np.zeros(0, np.int64)]), np.concatenate(out[1] or [np.zeros(0, np.int64)]), np.concatenate(out[2] or [np.zeros(0)])], ["query_id", "vec_id", "score"])

    found = entries.groupBy("cell", "block").cogroup(asked.groupBy("cell", "block")).applyInArrow(ranked, "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
