import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlens.llm import topk

SCHEMA = "vec_id long, embedding array<double>"


def brute(rows, asked, k):
    """By whole numbers of any size; an id counts by its best row."""
    usable = lambda rs: [(i, [int(np.floor(64 * x)) for x in v]) for i, v in rs if i is not None and v is not None and all(x is not None and np.isfinite(x) and np.isfinite(64 * x) for x in v)]
    out = {}
    for i, q in usable(asked):
        for j, c in usable(rows):
            if i != j and len(q) == len(c):
                s = sum(a * b for a, b in zip(q, c, strict=True))
                out.setdefault(i, {})[j] = max(s, out.get(i, {}).get(j, s))
    return sorted((i, r + 1, j, s) for i, d in out.items() for r, (j, s) in enumerate(sorted(d.items(), key=lambda x: (-x[1], x[0]))[:k]))


def found(df, asked, k, **more):
    return sorted(tuple(r) for r in topk.search(df, asked, k, **more).collect())


ODD = [(900, None), (901, [float("nan")] * 5), (902, [None] * 5), (903, [float("inf")] * 5), (None, [1.0] * 5), (904, []), (905, []), (906, [1.0, 2.0]), (907, [0.5, -2.0]), (908, [0.0] * 5), (909, [1e308] * 5)]


@pytest.mark.parametrize("tile", [4096, 16, 3])
def test_same_as_brute_force(spark, tile):
    rng = np.random.default_rng(tile)
    m = rng.integers(-3, 4, (150, 5)) / 4
    rows = [(int(i) * 5, m[i].tolist()) for i in range(150)] + ODD
    rows += [(10, [0.3] * 5), (10, [-0.3] * 5), (15, m[3].tolist()), (15, m[3].tolist()), (20, m[4].tolist())]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("score", F.lit("x")).withColumn("node", F.lit(None))
    asked = [r for r in rows if r[0] is None or r[0] % 10 == 0 or r[0] > 899]
    assert found(df, spark.createDataFrame(asked, SCHEMA), 7, tile=tile) == brute(rows, asked, 7)


def test_large_components_stay_exact(spark):
    rows = [(i, [x, 1.0, -y]) for i, (x, y) in enumerate([(3e7, 2.0), (3e7 + 1 / 64, 2.0), (-3e7, 0.25), (1e7, 1e7), (123456.75, 7.0)])]
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(df, df, 3) == brute(rows, rows, 3)
    far = spark.createDataFrame([(1, [1e300]), (2, [1e300]), (3, [-1e300])], SCHEMA)
    assert found(far, far.where("vec_id = 1"), 2) == [(1, 1, 2, 2**63 - 1), (1, 2, 3, -(2**63))]


def test_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [1.0])], SCHEMA)
    assert found(df, df, 20) == [(0, 1, 1, 4096), (1, 1, 0, 4096)]
    assert found(df.limit(0), df, 20) == [] == found(df, df.limit(0), 20)
