import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlens.operators import isolation as I


def table(spark, seed=1, n=2000):
    rng = np.random.default_rng(seed)
    m = rng.normal(size=(n, 3)) @ np.diag([1.0, 5.0, 0.1])
    rows = [(i, *map(float, x), 0) for i, x in enumerate(m)]
    rows += [(n + i, 30.0 + i, -90.0, 2.0, 1) for i in range(20)]
    return rows, spark.createDataFrame(rows, "id long, a double, b double, c double, odd int")


def plain_score(forest, x):
    """A row at a time, a node at a time."""
    total = 0.0
    for column, cut, child, path in forest.trees:
        node = 0
        while column[node] >= 0:
            node = child[node] + (0 if x[column[node]] < cut[node] else 1)
        total += path[node]
    return 2 ** -(total / len(forest.trees) / I.usual_path(forest.sample))


def test_scores_and_ranking(spark):
    rows, df = table(spark)
    forest = I.fit_forest(df.where("odd = 0"), "id", ("a", "b", "c"), trees=40, sample=128)
    assert len(forest.trees) == 40 and forest.sample == 128
    got = {r["id"]: r["s"] for r in df.select("id", I.isolation_score(forest).alias("s")).collect()}
    for r in rows[::50]:
        assert got[r[0]] == pytest.approx(plain_score(forest, r[1:4]), abs=1e-12)
    assert sorted(got, key=got.get)[-20:] == sorted(sorted(got, key=got.get)[-20:], key=got.get) and set(sorted(got, key=got.get)[-20:]) == set(range(2000, 2020))
    again = I.fit_forest(df.where("odd = 0").repartition(7, "a"), "id", ("a", "b", "c"), trees=40, sample=128)
    assert all(np.array_equal(x, y, equal_nan=True) for t, u in zip(forest.trees, again.trees, strict=True) for x, y in zip(t, u, strict=True))


def test_trees_hold_their_rows(spark):
    # every row of a sample reaches a leaf, and leaves know how deep they are
    rng = np.random.default_rng(3)
    x = rng.integers(0, 4, (60, 2)).astype(float)
    column, cut, child, path = I.grown(x, rng, 6)
    seen = {}
    for row in x:
        node = depth = 0
        while column[node] >= 0:
            node, depth = child[node] + (row[column[node]] >= cut[node]), depth + 1
        seen.setdefault(node, []).append(depth)
    for node, depths in seen.items():
        assert len(set(depths)) == 1 and path[node] == pytest.approx(depths[0] + I.usual_path(len(depths)))
    assert set(seen) == {i for i, c in enumerate(column) if c < 0}


def test_sample_is_exact_and_small(spark):
    df = spark.range(5000).withColumn("x", F.rand(1))
    n = {r["tree"]: r["count"] for r in I.sampled(df, "id", 10, 50, 3).groupBy("tree").count().collect()}
    assert n == dict.fromkeys(range(10), 50)
    assert I.sampled(df.limit(20), "id", 4, 50, 3).count() == 80


def test_missing_values_and_none(spark):
    df = spark.createDataFrame([(1, 0.5, None), (2, float("nan"), 1.0), (3, 1.0, 2.0), (4, 1.0, 2.0)], "id long, a double, b double")
    forest = I.fit_forest(df, "id", ("a", "b"), trees=3, sample=8)
    got = [r["s"] for r in df.select("id", I.isolation_score(forest).alias("s")).orderBy("id").collect()]
    assert got[:2] == [None, None] and got[2] == got[3] is not None
    empty = I.fit_forest(df.limit(0), "id", ("a", "b"), trees=3, sample=8)
    assert df.select(I.isolation_score(empty).alias("s")).collect()[2]["s"] == 0.5
    with pytest.raises(ValueError, match="two rows"):
        I.fit_forest(df, "id", ("a",), trees=0)
