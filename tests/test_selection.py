import pytest
from pyspark.sql import functions as F

from flowlens.operators import selection as S

SCHEMA = "candidate string, macro_f1 double, pr_auc double, recall double, fpr double, brier double, cv_std double"


def test_model_ranks(spark):
    rows = [("a", 0.8, None, 0.9, 0.1, 0.2, 0.0), ("b", 0.8, 0.1, 0.1, 0.9, 0.9, 0.9), ("c", 0.9, None, 0.0, 1.0, None, None), ("d", 0.8, None, 0.9, 0.1, 0.2, None), ("e", 0.8, None, 0.9, 0.1, 0.2, 0.0)]
    assert [r["candidate"] for r in S.select_model(spark.createDataFrame(rows, SCHEMA)).orderBy("place").collect()] == ["c", "b", "e", "a", "d"]


def test_anomaly_policies(spark):
    names = "candidate string, within_limit boolean, pr_auc double, f1 double, recall double, balanced_accuracy double, fpr double, fpr_std double, n_estimators long, max_samples double, max_features double"
    rows = [("x", False, 0.99, 0.9, 0.9, 0.9, 0.5, 0.0, 64, 1.0, 1.0), ("y", True, None, 0.5, 0.5, 0.7, 0.1, 0.0, 64, 1.0, 1.0), ("z", True, 0.2, 0.0, 0.0, 0.5, 0.0, 0.0, 64, 1.0, 1.0), ("w", False, 0.99, 0.9, 0.9, 0.9, 0.5, 0.0, 32, 1.0, 1.0), ("v", False, 0.99, 0.9, 0.9, 0.9, 0.5, 0.0, 64, 1.0, 1.0)]
    df = spark.createDataFrame(rows, names)
    ranked = lambda p: [r["candidate"] for r in S.select_anomaly_model(df, p).orderBy("place").collect()]
    assert ranked("1.0.0") == ["z", "y", "v", "w", "x"] and ranked("1.0.1") == ["w", "v", "x", "y"] and ranked("2.0.0") == ["v", "w", "x", "y"]
    with pytest.raises(ValueError, match="policy"):
        S.select_anomaly_model(df, "3")


def test_a_family_is_never_seen(spark):
    rows = [(f"{stage}-{i}", stage, family, int(family != "benign"), float(i)) for stage in ("early", "middle", "late") for i, family in enumerate(["benign", "scan", "bot"] * 4)]
    df = spark.createDataFrame(rows, "group_id string, stage string, family string, label int, x double")
    seen = []

    def fit(train, validation):
        seen.append((sorted({r["family"] for r in train.collect()}), sorted({r["family"] for r in validation.collect()})))
        return lambda part: part.withColumn("hit", F.col("family") == "bot")

    got = {r["family"]: r for r in S.leave_one_family_out(df, ["scan", "bot"], ["group_id"], fit).collect()}
    assert seen == [(["benign", "bot"],) * 2, (["benign", "scan"],) * 2]
    assert (got["scan"]["n"], got["scan"]["recall"], got["bot"]["recall"], got["bot"]["fpr"]) == (8, 0.0, 1.0, 0.0)
    mixed = df.withColumn("group_id", F.split("group_id", "-")[1])
    with pytest.raises(ValueError, match="group_id_overlap"):
        S.leave_one_family_out(mixed, ["bot"], ["group_id"], fit)
    leaked = S.without_family(df, "bot").withColumn("family", F.lit("bot"))
    assert {r["rule"] for r in S.isolation_violations(leaked, "bot", ["group_id"]).collect()} == {"family_leaked"}
