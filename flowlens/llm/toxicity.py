"""Toxicity by the nearest labelled examples under exact TF-IDF cosine, found through an inverted index.

A score is a function of the text alone. Terms are all those whose presence goes with the label, either way, beyond
chance (chi-square of at least ``CHI2`` in at least ``LEAST_DOCS`` examples); their document frequencies are counted
over all documents. At most ``SAMPLE`` labelled rows, drawn by a hash of the id, are
examples. The k nearest vote with the square of their cosine; an isotonic map, fitted on the examples with each
left out of its own vote, turns votes into calibrated scores.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import ranges, texts_of, written

SAMPLE = 20_000
#: chance alone goes beyond it for one term in a thousand
CHI2 = 10.83
LEAST_DOCS = 5
NEIGHBOURS = 32
#: texts scored at once
BLOCK = 64
#: a term of more than this share of the examples has a dense row
DENSE = 0.02
#: weight of the overall rate among the votes
PRIOR = 0.5
THRESHOLD = 0.3
WORD = re.compile(r"\w+")


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


@dataclass
class Index:
    """Examples by term: postings of the rare terms, dense rows of the frequent ones; and each example's own vector."""

    ids: np.ndarray
    labels: np.ndarray
    #: postings by term, without those of frequent terms
    entry: np.ndarray
    weight: np.ndarray
    bounds: np.ndarray
    #: the row of a frequent term in dense, or -1
    row: np.ndarray
    dense: np.ndarray
    #: vectors by example
    own_term: np.ndarray
    own_weight: np.ndarray
    own_bounds: np.ndarray

    @classmethod
    def build(cls, ids: np.ndarray, labels: np.ndarray, vectors: list[tuple[np.ndarray, np.ndarray]], terms: int) -> Index:
        order = np.argsort(ids, kind="stable")
        term = np.concatenate([vectors[i][0] for i in order] or [np.zeros(0)]).astype(np.int64)
        weight = np.concatenate([vectors[i][1] for i in order] or [np.zeros(0)]).astype(float)
        sizes = np.array([len(vectors[i][0]) for i in order], np.int64)
        entry = np.repeat(np.arange(len(ids)), sizes)
        often = np.bincount(term, minlength=terms) > DENSE * len(ids)
        row = np.where(often, np.cumsum(often) - 1, -1)
        dense = np.zeros((int(often.sum()), len(ids)), np.float32)
        thick = often[term]
        dense[row[term[thick]], entry[thick]] = weight[thick]
        t, e, w = term[~thick], entry[~thick], weight[~thick]
        place = np.lexsort((e, t))
        bounds = np.searchsorted(t[place], np.arange(terms + 1))
        return cls(ids[order], labels[order], e[place], w[place], bounds, row, dense, term, weight, np.r_[0, np.cumsum(sizes)])

    def nearest_of(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int, without: list[int] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query at most k entries of the largest positive cosines, largest first, and ties by id.

        Exact: single precision finds every entry that can be among the k, and these are compared in double precision.
        """
        found = []
        for first in range(0, len(queries), BLOCK):
            part = queries[first : first + BLOCK]
            thick = np.zeros((len(part), len(self.dense)), np.float32)
            for i, (t, w) in enumerate(part):
                often = self.row[t] >= 0
                thick[i, self.row[t[often]]] = w[often]
            near = thick @ self.dense
            for i, (t, w) in enumerate(part):
                starts, lengths = self.bounds[t], self.bounds[t + 1] - self.bounds[t]
                at = ranges(starts, lengths)
                cosine = near[i]
                if len(at):
                    cosine = cosine + np.bincount(self.entry[at], np.repeat(w, lengths) * self.weight[at], minlength=len(self.ids))
                if without is not None and without[first + i] >= 0:
                    cosine[without[first + i]] = 0
                least = np.partition(cosine, -k)[-k] - 1e-5 if len(cosine) > k else 0.0
                entries = np.flatnonzero((cosine > 0) & (cosine >= least))
                query = np.zeros(len(self.row))
                query[t] = w
                starts, lengths = self.own_bounds[entries], self.own_bounds[entries + 1] - self.own_bounds[entries]
                at = ranges(starts, lengths)
                exact = np.bincount(np.repeat(np.arange(len(entries)), lengths), query[self.own_term[at]] * self.own_weight[at], minlength=len(entries))
                keep = np.lexsort((entries, -np.round(exact, 12)))[:k]
                found.append((entries[keep], exact[keep]))
        return found

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        return self.nearest_of([(terms, weights)], k, [without])[0]


def vote(scores: np.ndarray, labels: np.ndarray, rate: float) -> float:
    w = scores * scores
    return float((w @ labels + PRIOR * rate) / (w.sum() + PRIOR))


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the least-squares increasing fit: equal x are one pool, pools of adjacent violators another, each at its mean x."""
    values, of, counts = np.unique(x, return_inverse=True, return_counts=True)
    pools: list[list[float]] = []
    for a, b, n in zip(values.tolist(), (np.bincount(of, y, minlength=len(values)) / counts).tolist(), counts.tolist(), strict=True):
        pools.append([a, b, float(n)])
        while len(pools) > 1 and pools[-2][1] >= pools[-1][1]:
            a2, b2, n2 = pools.pop()
            a1, b1, n1 = pools[-1]
            pools[-1] = [(a1 * n1 + a2 * n2) / (n1 + n2), (b1 * n1 + b2 * n2) / (n1 + n2), n1 + n2]
    return np.array([p[0] for p in pools]), np.array([p[1] for p in pools])


def weighted(idf: np.ndarray, terms: list[int], counts: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The TF-IDF vector of length 1 with logarithmic term counts."""
    t = np.array(terms, np.int64)
    w = (1 + np.log(np.array(counts, float))) * idf[t]
    return t, w / np.sqrt((w * w).sum()) if len(w) else w


@dataclass
class Model:
    terms: dict[str, int]
    idf: np.ndarray
    index: Index
    rate: float
    #: rate among the examples without any of the terms
    empty_rate: float
    knots: tuple[np.ndarray, np.ndarray]

    def scores(self, texts: list[tuple[tuple[int, ...], tuple[int, ...]]], k: int) -> list[tuple[float, list[dict]]]:
        """Score and evidence of each (terms, counts)."""
        near = iter(self.index.nearest_of([weighted(self.idf, t, c) for t, c in texts if t], k))
        out = []
        for t, _ in texts:
            if not t:
                out.append((self.empty_rate, []))
                continue
            entries, cosines = next(near)
            raw = vote(cosines, self.index.labels[entries], self.rate)
            shown = [{"doc_id": int(self.index.ids[e]), "similarity": float(c), "toxic": int(self.index.labels[e])} for e, c in zip(entries[:3], cosines[:3], strict=True)]
            out.append((float(np.interp(raw, *self.knots)), shown))
        return out


def term_counts(documents: DataFrame, terms: list[str]) -> DataFrame:
    """(doc_id, terms array<int>, counts array<int>): which of the terms each text holds, and how often."""
    number = {t: i for i, t in enumerate(terms)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ts, cs = [], []
            for text in batch.column("text"):
                held = Counter(filter(None.__ne__, map(number.get, words_of(text.as_py()))))
                ts.append(sorted(held))
                cs.append([held[t] for t in ts[-1]])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ts, pa.list_(pa.int32())), pa.array(cs, pa.list_(pa.int32()))], ["doc_id", "terms", "counts"])

    return documents.mapInArrow(run, "doc_id long, terms array<int>, counts array<int>")


def telling_terms(examples: DataFrame, chi2: float = CHI2, least: int = LEAST_DOCS) -> list[str]:
    """The terms of (text, y) whose presence goes with y, strongest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with_, without = Counter(), Counter()
        for batch in batches:
            for text, y in zip(batch.column("text"), batch.column("y"), strict=True):
                (with_ if y.as_py() else without).update(set(words_of(text.as_py())))
        words = list(with_ | without)
        yield pa.RecordBatch.from_pydict({"term": words, "n1": [with_[w] for w in words], "n0": [without[w] for w in words]}, schema=pa.schema([("term", pa.string()), ("n1", pa.int64()), ("n0", pa.int64())]))

    totals = examples.agg(F.sum("y").alias("y1"), F.sum(1 - F.col("y")).alias("y0")).first()
    if not totals["y1"] or not totals["y0"]:
        return []
    y1, y0 = float(totals["y1"]), float(totals["y0"])
    seen = examples.mapInArrow(run, "term string, n1 long, n0 long").groupBy("term").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    n1, n0 = F.col("n1").cast("double"), F.col("n0").cast("double")
    cross = n1 * (F.lit(y0) - n0) - n0 * (F.lit(y1) - n1)
    stat = (y1 + y0) * cross * cross / (y1 * y0 * (n1 + n0) * (F.lit(y1 + y0) - n1 - n0))
    ranked = seen.where((F.col("n1") + F.col("n0") >= least) & (F.col("n1") + F.col("n0") < y1 + y0)).withColumn("chi2", stat).where(F.col("chi2") >= chi2)
    return [r["term"] for r in ranked.orderBy(F.desc("chi2"), "term").collect()]


def fit(counted: DataFrame, labels: DataFrame, terms: list[str], k: int = NEIGHBOURS) -> Model:
    """The model from the term counts of all documents and the examples (doc_id, y), of which there are a bounded number."""
    n = counted.count()
    idf = np.full(len(terms), np.log(1 + n) + 1)
    # at most as many rows as terms
    for row in counted.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
        idf[row["t"]] = np.log((1 + n) / (1 + row["count"])) + 1
    examples = written(counted.join(F.broadcast(labels), "doc_id"), "example-terms")
    rows = examples.orderBy("doc_id", "terms", "counts").toArrow().to_pylist()
    y = np.array([r["y"] for r in rows], float)
    rate = float(y.mean()) if len(y) else 0.0
    vectors = [weighted(idf, r["terms"], r["counts"]) for r in rows]
    bare = np.array([not len(t) for t, _ in vectors], bool)
    index = Index.build(np.array([r["doc_id"] for r in rows], np.int64), y, vectors, len(terms))
    model = Model({t: i for i, t in enumerate(terms)}, idf, index, rate, float((y[bare].sum() + rate) / (bare.sum() + 1)), (np.array([0.0]), np.array([rate])))
    shared = counted.sparkSession.sparkContext.broadcast(model)

    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        place = {int(i): e for e, i in enumerate(m.index.ids)}
        for batch in batches:
            texts = [weighted(m.idf, t, c) for t, c in zip(batch.column("terms").to_pylist(), batch.column("counts").to_pylist(), strict=True)]
            near = m.index.nearest_of(texts, k, [place[i] for i in batch.column("doc_id").to_pylist()])
            raw = [vote(cosines, m.index.labels[entries], m.rate) for entries, cosines in near]
            yield pa.RecordBatch.from_arrays([pa.array(raw, pa.float64()), batch.column("y")], ["raw", "y"])

    tried = examples.where("size(terms) > 0").repartition(counted.sparkSession.sparkContext.defaultParallelism).mapInArrow(votes, "raw double, y int").toArrow()
    if tried.num_rows:
        model.knots = isotonic(tried["raw"].to_numpy(), tried["y"].to_numpy().astype(float))
    return model


def scored(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, k: int = NEIGHBOURS) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted and evidence (its nearest examples with similarity and label).

    Null texts are empty and get the rate among examples without any term; rows with a null id are left out; rows
    that repeat an id are scored each, and as examples count once for each text. A label row without an id or label
    is no example; labels that differ for an id count as toxic if any is. Without labels every score is 0.
    """
    documents = texts_of(documents, id_col, text_col)
    rows = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("doc_id is not null and y is not null")
    rows = rows.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg((F.max("y") > 0).cast("int").alias("y"))
    rows = written(rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample), "examples")
    examples = written(documents.join(F.broadcast(rows), "doc_id").select("text", "y"), "example-texts")
    terms = telling_terms(examples)
    counted = written(term_counts(documents, terms), "term-counts")
    model = counted.sparkSession.sparkContext.broadcast(fit(counted, rows, terms, k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, tuple] = {}
        for batch in batches:
            keys = [(tuple(t), tuple(c)) for t, c in zip(batch.column("terms").to_pylist(), batch.column("counts").to_pylist(), strict=True)]
            if len(known) > 50_000:
                known.clear()
            new = list(dict.fromkeys(x for x in keys if x not in known))
            known.update(zip(new, model.value.scores(new, k), strict=True))
            out = [known[x] for x in keys]
            evidence = pa.array([e for _, e in out], pa.list_(pa.struct([("doc_id", pa.int64()), ("similarity", pa.float64()), ("toxic", pa.int32())])))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([s for s, _ in out], pa.float64()), evidence], ["doc_id", "score", "evidence"])

    found = counted.mapInArrow(run, "doc_id long, score double, evidence array<struct<doc_id: long, similarity: double, toxic: int>>")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "evidence")


def accepted(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of documents that aren't predicted toxic, with all their columns; rows without an id stay."""
    rejected = scored(documents, labels, id_col, text_col).where("predicted = 1").select(F.col("doc_id").alias("_id")).distinct()
    return documents.join(rejected, F.col(id_col).cast("long") == F.col("_id"), "left_anti")
