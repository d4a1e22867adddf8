import random
import re

import pytest
from pyspark.sql import functions as F

from flowlens.llm import jaccard


def brute(docs, percent=75):
    sets = {}
    for i, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    by_shingle = {}
    for i in ids:
        for s in sets[i]:
            by_shingle.setdefault(s, []).append(i)
    for a, b in {(a, b) for v in by_shingle.values() for a in v for b in v if a < b}:
        inter = len(sets[a] & sets[b])
        if 100 * inter >= percent * (len(sets[a]) + len(sets[b]) - inter):
            x, y = sorted((root(a), root(b)))
            up[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


def result(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join_components(df).collect()}


def test_whole_table(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    want = brute([(r["doc_id"], r["text"]) for r in df.collect()])
    assert result(df) == want
    assert any(i != c for i, (_, c) in want.items())


@pytest.mark.parametrize("seed", [1, 2])
def test_near_copies(spark, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    docs = []
    for g in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([3, 5, 8, 30, 60]))]
        for _ in range(rng.randrange(1, 12)):
            w = list(base)
            for _ in range(rng.randrange(0, 3)):
                w[rng.randrange(len(w))] = rng.choice(words)
            docs.append((len(docs) * 3 + g, rng.choice([" ", "\t", "\n "]).join(w).title()))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert result(df) == brute(docs)


def test_edges(spark):
    docs = [(1, None), (2, ""), (3, " \t\n"), (4, "a b"), (5, "A B"), (6, "a b c"), (7, "x " * 40000), (8, "X " * 30000), (None, "a b"), (9, "é É a"), (10, "É É a")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"n": F.lit(1), "h": F.lit("x"), "label": F.lit(2)})
    assert result(df) == brute([d for d in docs if d[0] is not None])
    assert result(df.limit(0)) == {}
    assert sorted(r["doc_id"] or 0 for r in jaccard.one_of_each(df).collect()) == [0, 1, 2, 3, 4, 6, 7, 9, 10]
    assert jaccard.join_components(df.union(df)).count() == 20
