import random

import pytest
from pyspark.sql import functions as F

from flowlens.operators import isolation as I
from flowlens.operators import models as M


def rows(spark, n=900):
    rng = random.Random(2)
    out = []
    for i in range(n):
        y = int(i % 3 == 0)
        out.append((i, i // 30, y, rng.gauss(2.0 * y, 0.7), rng.random()))
    return spark.createDataFrame(out, "id long, group_id long, label long, x double, z double")


def test_folds_keep_groups_whole_and_even(spark):
    sizes = [9, 1, 4, 4, 7, 2, 2, 6, 5, 1]
    df = spark.createDataFrame([(g, i % 2, g % 3) for g, n in enumerate(sizes) for i in range(n)], "g long, label int, source int")
    folds = {r["g"]: r["fold"] for r in M.group_folds(df, "g", 3).collect()}
    sums, want = [0] * 3, {}
    for g in sorted(range(10), key=lambda g: (-sizes[g], g)):
        want[g] = sums.index(min(sums))
        sums[want[g]] += sizes[g]
    assert folds == want and max(sums) - min(sums) <= 1
    rules = lambda d, *keys: {(r["rule"], r["value"]) for r in M.fold_violations(d, M.group_folds(d, "g", 3), "g", "label", keys).collect()}
    assert rules(df) == set() and {r for r, _ in rules(df, "source")} == {"source_overlap"}
    assert {r for r, _ in rules(df.withColumn("label", F.lit(1)))} == {"single_class"}
    assert ("too_few_groups", "1") in rules(df.where("g = 0"))
    with pytest.raises(ValueError, match="refused"):
        M.tune(df.withColumn("x", F.lit(1.0)).withColumn("label", (F.col("g") == 0).cast("int")), ("x",), M.group_folds(df, "g", 3), "g")


def test_a_real_signal_is_found_scored_and_detected(spark):
    df = rows(spark)
    tuned = M.tune(df, ("x", "z"), M.group_folds(df, "group_id", 3), "group_id", ("decision_tree", "logistic_regression"))
    best = tuned.where("place = 1").first()
    assert best["macro_f1"] > 0.85 and best["pr_auc"] > 0.9
    model = M.fitted(df.where("id < 600"), ("x", "z"), best["candidate"])
    ranked, calibrated = M.calibrate(M.with_probability(model, df.where("id >= 600")))
    assert {r["method"] for r in ranked.collect()} == {"isotonic", "sigmoid"}
    forest = I.fit_forest(df.where("label = 0"), "id", ("x", "z"), trees=20, sample=64)
    ranks = M.benign_ranks(df.where("label = 0").withColumn("raw", I.isolation_score(forest)), "raw")
    scored = M.score_flows(df, model, calibrated, I.isolation_score(forest), ranks=ranks)
    got = M.detect(scored, 0.5)
    assert got.count() == 900 and got.where("not (supervised between 0 and 1 and anomaly between 0 and 1 and fusion between 0 and 1)").count() == 0
    right = got.agg(F.avg((F.col("alert_required").cast("int") == F.col("label")).cast("int"))).first()[0]
    assert right > 0.85


def test_calibration_needs_both_classes(spark):
    df = spark.createDataFrame([(0.2, 0), (0.4, 0), (0.9, 1)], "p double, label long")
    ranked, column = M.calibrate(df)
    assert [r["method"] for r in ranked.collect()] == ["none"] and [r[0] for r in df.select(column).collect()] == [0.2, 0.4, 0.9]
