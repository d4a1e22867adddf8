import numpy as np
from pyspark.sql import functions as F

from flowlens.llm import mixing


def test_rates_meet_targets(spark):
    rng = np.random.default_rng(1)
    p = rng.dirichlet([1, 1, 1], 300)
    n = rng.integers(1, 500, 300)
    df = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(n, p)], "n_tokens long, p array<double>")
    have = (n[:, None] * p).sum(0)
    goal = have * [1.3, 0.7, 1.1]
    rated, expected = mixing.rates(df, goal.tolist())
    got = rated.toPandas()
    r = got.rate.to_numpy()
    assert (r >= 0).all() and np.allclose((r[:, None] * got.n_tokens.to_numpy()[:, None] * np.stack(got.p)).sum(0), goal, rtol=2e-3)
    # from the floor upwards
    up, reached = mixing.rates(df, (have * [1.25, 1.0, 1.25]).tolist(), floor=1.0)
    assert up.agg({"rate": "min"}).first()[0] >= 1 and up.agg({"rate": "max"}).first()[0] < 20 
    assert np.abs(reached - have * [1.25, 1.0, 1.25]).sum() < np.abs(have - have * [1.25, 1.0, 1.25]).sum()
    # brute force: the same projected gradient on plain arrays
    x = np.ones(300)
    q, m, t = p, n / n.sum(), goal.sum()
    for _ in range(20000):
        miss = ((x * n) @ q - goal) / t
        x = np.maximum(0, x - 0.2 * (q @ miss * n.sum() / t))
    assert np.abs(((x - r) * m)[:, None] * q).sum() < 0.02


def test_query_shape(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = mixing.mixed(docs, mixing.domains_of(labels), {"good": 0.7, "poor": 0.2, "toxic": 0.1})
    rows = out.toPandas()
    assert len(rows) == docs.count() and (rows.rate >= 0).all()
    assert abs(rows.expected_tokens.sum() / rows.n_tokens.sum() - 1) < 0.02


def test_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, "a b"), (2, "c"), (None, "x"), (3, "w " * 50000)], "doc_id long, text string").withColumn("rate", F.lit("x"))
    none = spark.createDataFrame([], "doc_id long, domain string")
    rated = mixing.mixed(docs, none)
    assert rated.count() == 4 and {r["domain"] for r in rated.collect()} == {"all"}
    assert mixing.mixed(docs.limit(0), none).count() == 0
    doubled = mixing.repeated_to_rates(docs, rated.withColumn("rate", F.lit(2.0)))
    assert doubled.columns == docs.columns and doubled.count() == 9


def test_rates_at_the_floor_reach_the_minimum(spark):
    rng = np.random.default_rng(2)
    p = rng.dirichlet([0.05, 0.3, 1], 300)
    n = rng.integers(1, 500, 300)
    df = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(n, p)], "n_tokens long, p array<double>")
    # within reach, as there are such rates: most at the floor, the others well above it
    goal = (n[:, None] * p * np.where(p[:, :1] > 0.1, 5.0, 1.0)[:, [0]]).sum(0)
    rated, expected = mixing.rates(df, goal.tolist(), floor=1.0)
    assert rated.agg({"rate": "min"}).first()[0] >= 1
    assert np.abs(expected - goal).max() <= mixing.CLOSE * goal.sum()
    # out of reach: as near as a long plain search comes
    goal = (n[:, None] * p).sum(0) * [1.3, 1.0, 1.2]
    _, expected = mixing.rates(df, goal.tolist(), floor=1.0)
    x = np.ones(300)
    for _ in range(20000):
        x = np.maximum(1, x - 0.5 * (p @ (((x * n) @ p - goal) / goal.sum())))
    least = np.linalg.norm((x * n) @ p - goal) / goal.sum()
    assert np.linalg.norm(expected - goal) / goal.sum() <= least + 1e-5


def test_miss_is_told(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = mixing.mixed(docs, mixing.domains_of(labels), {"good": 0.7, "poor": 0.2, "toxic": 0.1}).toPandas()
    assert rows.groupby("domain").miss.nunique().eq(1).all() and rows.miss.abs().max() < 0.02
