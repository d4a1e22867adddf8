import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlens.llm import ann, embed_dedup


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


ODD = [(9001, None, 1), (9002, [0.0] * 8, 1), (9003, [float("nan")] * 8, 1), (9004, [None] * 8, 1), (9005, [float("inf")] * 8, 1), (9006, [1.0] * 8, None), (None, [1.0] * 8, 1), (9007, [], 1), (9008, [1.0] * 3, 1)]


def vectors(seed, n=400, width=8):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(20, width))
    m = base[rng.integers(0, 20, n)] + rng.normal(size=(n, width)) * rng.choice([0.01, 0.1, 1], n)[:, None]
    m[n // 2] = m[n // 2 + 1]
    return [(i * 3, m[i].astype(np.float32).tolist(), int(rng.integers(0, 2))) for i in range(n)]


def cosines(rows):
    m = np.array([r[1] for r in rows], np.float32).astype(float)
    u = m / np.sqrt((m * m).sum(1, keepdims=True))
    return u @ u.T


@pytest.mark.parametrize("block", [5000, 16])
def test_links(spark, block):
    rows = vectors(1)
    want = cosines(rows) >= 0.98
    label = np.array([r[2] for r in rows])
    want &= label[:, None] == label[None]
    want = {(rows[a][0], rows[b][0]) for a, b in zip(*np.nonzero(np.triu(want, 1)))}
    pairs = [tuple(r) for r in embed_dedup.linked_pairs(table(spark, rows + ODD), block=block).collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) <= want and len(pairs) >= 0.98 * len(want)


def test_components(spark):
    got = {r["vec_id"]: r for r in embed_dedup.near_duplicates(table(spark, vectors(2) + ODD)).collect()}
    assert len(got) == 409 and all(got[i]["n_links"] == 0 and got[i]["kept"] for i in range(9001, 9009))
    assert not got[None]["kept"] and any(r["n_links"] > 3 for r in got.values())
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for i, r in got.items() if i is not None)
    assert embed_dedup.near_duplicates(table(spark, []).limit(0)).count() == 0


def test_search(spark):
    rows = vectors(3, 600)
    df = table(spark, rows + ODD)
    c = cosines(rows)
    np.fill_diagonal(c, -9)
    ids = np.array([r[0] for r in rows])
    got = ann.search(df, df.where("vec_id % 50 = 0"), least=100).toPandas()
    hits = total = 0
    for i in np.flatnonzero(ids % 50 == 0):
        mine = got[got.query_id == ids[i]].sort_values("rank")
        best = np.lexsort((ids, -c[i]))[:5]
        hits += len(set(mine.vec_id) & set(ids[best]))
        total += 5
        assert np.allclose(mine.score, [c[i][np.flatnonzero(ids == v)[0]] for v in mine.vec_id], atol=1e-12) and mine["rank"].tolist() == [1, 2, 3, 4, 5]
    assert hits / total >= 0.9
    few = table(spark, rows[:3] + ODD)
    assert ann.search(few, few.where("vec_id % 50 = 0")).count() == 3
    assert ann.search(few.limit(0), few).count() == 0


def test_recall_of_the_query(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    t = df.toPandas()
    m = np.stack(t.embedding).astype(float)
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    got = ann.search(df, df.where("vec_id % 50 = 0")).toPandas().groupby("query_id").vec_id.apply(set)
    ids, hits = t.vec_id.to_numpy(), 0
    q = np.flatnonzero(ids % 50 == 0)
    for i in q:
        c = u @ u[i]
        c[i] = -9
        hits += len(got[ids[i]] & set(ids[np.lexsort((ids, -c))[:5]]))
    assert hits / (5 * len(q)) >= 0.9


def test_rows_that_repeat_an_id_are_one_candidate(spark):
    df = spark.createDataFrame([(i, [float(i % 7), 1.0 + i, float(i % 3)]) for i in range(40)], "vec_id long, embedding array<double>")
    plain = lambda x: sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in x.collect())
    want = plain(ann.search(df, df.where("vec_id % 10 = 0")))
    twice = df.union(df).withColumn("score", F.lit("x"))
    assert plain(ann.search(twice, twice.where("vec_id % 10 = 0"))) == want and len(want) == 20
