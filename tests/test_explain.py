import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlens.operators import explain as X
from flowlens.operators import metrics as E
from flowlens.operators import models as M
from flowlens.operators import ranks as R

NAMES = ("x", "y", "z")


def table(spark, n=500):
    rng = random.Random(5)
    rows = [(i, rng.gauss(0, 1), rng.gauss(0, 1), rng.choice([0.0, 1.0, 1.0])) for i in range(n)]
    rows = [(i, x, y, z, int(x + 0.3 * y + rng.gauss(0, 0.3) > 0)) for i, x, y, z in rows]
    return rows, spark.createDataFrame(rows, "id long, x double, y double, z double, label int")


def score(df):
    return df.withColumn("risk", F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.5 + 0.2 * F.col("x") - 0.2 * F.col("y") + 0 * F.col("z"))))


def test_contributions_by_brute_force(spark):
    rows, df = table(spark)
    profile = X.reference_profile(df.where("label = 0"), NAMES)
    benign = np.array([r[1:4] for r in rows if r[4] == 0])
    median = np.median(benign, 0)
    assert {r["feature"]: (r["i"], r["n"]) for r in profile.collect()} == {f: (i, len(benign)) for i, f in enumerate(NAMES)}
    risk = lambda v: max(0.0, min(1.0, 0.5 + 0.2 * v[0] - 0.2 * v[1]))
    got = {r["id"]: r["contributions"] for r in X.local_contributions(df, "id", NAMES, profile, score, 2).collect()}
    for i, *v, _ in rows:
        deltas = []
        for k in range(3):
            w = list(v)
            w[k] = median[k]
            d = risk(v) - risk(w)
            deltas.append(0.0 if abs(d) <= 1e-12 else d)
        want = sorted(range(3), key=lambda k: (-abs(deltas[k]), k))[:2]
        assert [c["feature"] for c in got[i]] == [NAMES[k] for k in want]
        for c, k in zip(got[i], want, strict=True):
            assert c["delta"] == pytest.approx(deltas[k], abs=1e-12) and c["observed"] == v[k] and c["median"] == pytest.approx(median[k])
            assert c["direction"] == ("neutral" if deltas[k] == 0 else "increases_suspicion" if deltas[k] > 0 else "decreases_suspicion")
    with pytest.raises(ValueError, match="lacks"):
        X.local_contributions(df, "id", (*NAMES, "label"), profile, score)
    assert [(r["rule"], r["n"]) for r in X.profile_violations(df.withColumn("split", F.lit("train")), "split", "label").collect()] == [("attack", sum(r[4] for r in rows))]


def test_permutation_moves_one_feature_over_the_whole_table(spark, monkeypatch):
    monkeypatch.setattr(R, "BUCKET_ROWS", 5)
    rows, df = table(spark)
    out = X.permuted(df, "id", NAMES, 2, 3).toPandas()
    before = {f: sorted(r[1 + k] for r in rows) for k, f in enumerate(NAMES)}
    plain = {r[0]: r[1:4] for r in rows}
    for (feature, _), part in out.groupby(["feature", "repeat"]):
        assert sorted(part["id"]) == [r[0] for r in rows] and all(sorted(part[f]) == before[f] for f in NAMES)
        moved = [k for k, f in enumerate(NAMES) if any(plain[i][k] != v for i, v in zip(part["id"], part[f], strict=True))]
        assert moved == [NAMES.index(feature)]
    assert len(out.groupby(["feature", "repeat"])) == 6


def test_importance_of_signal_and_noise(spark):
    _, df = table(spark)
    metric = lambda rows, by: E.confusion_metrics(rows, by, F.col("label"), F.col("p") >= 0.5).select(*by, F.col("macro_f1").alias("value"))
    model = M.fitted(df, NAMES, "logistic_regression")
    got = {r["feature"]: r for r in X.permutation_importance(df, "id", NAMES, lambda d: M.with_probability(model, d), metric, 3).collect()}
    assert got["x"]["mean"] > 0.2 > got["y"]["mean"] > 0.01 and abs(got["z"]["mean"]) < 0.02 and got["x"]["std"] > 0
    assert [r[1] for r in X.tree_importance(model, NAMES)] == ["not_applicable"] * 3
    forest = dict((f, v) for f, _, v in X.tree_importance(M.fitted(df, NAMES, "random_forest"), NAMES))
    assert forest["x"] > forest["y"] > forest["z"] and sum(forest.values()) == pytest.approx(1)


@pytest.mark.parametrize("stretches", [64, 3, 2])
def test_quantiles_are_exact(spark, monkeypatch, stretches):
    monkeypatch.setattr(R, "STRETCHES", stretches)
    rng = np.random.default_rng(2)
    rows = [("a", float(v)) for v in rng.normal(size=400)] + [("b", float(v)) for v in rng.integers(0, 3, 50)] + [("c", 7.0), ("a", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r["k"]: r for r in R.exact_quantiles(R.value_counts(df, ["k"], "v"), ["k"], {"q1": 0.1, "q5": 0.5, "q97": 0.975, "q0": 0.0, "q100": 1.0}).collect()}
    for k in "abc":
        v = [x for kk, x in rows if kk == k and x is not None]
        assert got[k]["n"] == len(v)
        for name, p in (("q1", 0.1), ("q5", 0.5), ("q97", 0.975), ("q0", 0.0), ("q100", 1.0)):
            assert got[k][name] == pytest.approx(np.quantile(v, p), abs=1e-12)
    assert "percentile(" not in R.exact_quantiles(R.value_counts(df, ["k"], "v"), ["k"], {"m": 0.5})._jdf.queryExecution().optimizedPlan().toString()
    assert R.exact_quantiles(R.value_counts(df.limit(0), ["k"], "v"), ["k"], {"m": 0.5}).count() == 0


def test_detections_have_reasons_ids_and_contributions(spark):
    _, df = table(spark)
    profile = X.reference_profile(df.where("label = 0"), NAMES)
    scores = lambda d: score(d).select("*", F.col("risk").alias("supervised"), F.lit(0.95).alias("anomaly"), F.col("risk").alias("fusion")).drop("risk")
    found = M.detections(df, "id", NAMES, scores, profile)
    got = found.collect()
    assert len(got) == 500 == len({r["detection_id"] for r in got}) and all(len(r["contributions"]) == 3 for r in got)
    for r in got:
        assert r["alert_required"] == (r["risk"] >= 0.7) and ("MULTI_ENGINE_SUPPORT" in r["codes"]) == (r["supervised"] >= 0.5) and "ANOMALY_HIGH_SCORE" in r["codes"]
    assert {r["id"]: r["detection_id"] for r in M.detections(df.repartition(3), "id", NAMES, scores, profile).collect()} == {r["id"]: r["detection_id"] for r in got}


def test_contributions_need_no_shuffle(spark):
    _, df = table(spark)
    profile = X.reference_profile(df.where("label = 0"), NAMES)
    out = X.local_contributions(df, "id", NAMES, profile, score, 2)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.count() == 500 and X.local_contributions(df.where("id < 0"), "id", NAMES, profile, score, 2).count() == 0
    with pytest.raises(Exception, match="moves or drops rows"):
        X.local_contributions(df, "id", NAMES, profile, lambda x: score(x).where("i <> 1"), 2).collect()
