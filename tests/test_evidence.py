import hashlib
import json

from pyspark.sql import functions as F

from flowlens.operators import evidence as V

ROWS = [(i, "train" if g < 3 else "test", g, int(i % 4 == 0), f"f{g}", float(i), float(i % 4 == 0)) for i, g in ((i, i % 5) for i in range(60))]
SCHEMA = "record_id long, split string, group_id long, label int, source_file string, x double, y double"
COLUMNS = ["record_id", "label", "x"]


def test_snapshots_equal_pythons(spark):
    values = [(1, 0.1, "é \"q\" \\ 日本 😀", None), (2, 1e16, "", 5), (3, -1.5e-7, "a/b\n", 0), (4, 100.0, "x", -3), (5, 12345678.9, "y", 2**62), (6, 0.0001, "z", 1), (7, 1e22, "w", 1)]
    alerts = spark.createDataFrame(values, "alert_id long, risk double, note string, n long")
    flows = spark.createDataFrame([("f1", "tcp", "malicious")], "flow_id string, protocol string, label string")
    refs = spark.createDataFrame([("security_alert", str(v[0])) for v in values] + [("network_flow", "f1"), ("network_flow", "f2"), ("case", "1"), ("security_alert", None)], "object_type string, object_id string")
    got = {(r["object_type"], r["object_id"]): r for r in V.resolve_evidence(refs, {"security_alert": (alerts, "alert_id"), "network_flow": (flows, "flow_id")}).collect()}
    for i, risk, note, n in values:
        want = json.dumps({"alert_id": i, "risk": risk, "note": note, "n": n}, sort_keys=True, separators=(",", ":"))
        assert got["security_alert", str(i)]["snapshot"] == want and got["security_alert", str(i)]["checksum"] == hashlib.sha256(want.encode()).hexdigest()
    assert got["network_flow", "f1"]["snapshot"] == '{"flow_id":"f1","protocol":"tcp"}'
    assert [got[k]["status"] for k in (("network_flow", "f1"), ("network_flow", "f2"), ("case", "1"), ("security_alert", None))] == ["resolved", "missing", "unknown_type", "missing"]


def test_gate_names_what_differs(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    frozen = spark.createDataFrame(V.split_inventory(df, "split", "group_id", "label", COLUMNS).collect())
    rules = lambda d, **more: sorted((r["split"], r["rule"]) for r in V.gate_violations(d, "split", "group_id", "label", COLUMNS, frozen, **more).collect())
    assert rules(df.repartition(5).orderBy(F.desc("x"))) == []
    assert rules(df.withColumn("x", F.when(F.col("record_id") == 7, 7.5).otherwise(F.col("x")))) == [("train", "digest_differ")]
    assert rules(df.where("record_id <> 8")) == [("test", "attacks_differ"), ("test", "digest_differ"), ("test", "n_differ")]
    assert rules(df.union(df.where("record_id = 1"))) == [("train", "digest_differ"), ("train", "n_differ")]
    assert rules(df.where("split = 'train'")) == [("test", "missing_split")]
    assert ("all", "group_overlap") in rules(df.withColumn("split", F.when(F.col("record_id") == 0, "test").otherwise(F.col("split"))))
    assert rules(df, selection_status="open", test_seen=True) == [("test", "selection_not_frozen"), ("test", "test_seen")]


def test_rows_that_differ_are_named(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    frozen = V.row_inventory(df, "record_id", "split", COLUMNS)
    now = df.where("record_id <> 5").union(df.where("record_id = 6")).union(spark.createDataFrame([(99, "train", 0, 0, "f0", 1.0, 0.0)], SCHEMA))
    now = now.withColumn("x", F.when(F.col("record_id") == 7, 7.5).otherwise(F.col("x"))).withColumn("split", F.when(F.col("record_id") == 9, "train").otherwise(F.col("split")))
    got = {r["id"]: r["rule"] for r in V.changed_rows(now, frozen, "record_id", "split", COLUMNS).collect()}
    assert got == {"5": "missing", "6": "extra", "99": "extra", "7": "changed", "9": "moved"}
    assert V.changed_rows(df, frozen, "record_id", "split", COLUMNS).isEmpty()


def test_leakage_report(spark):
    df = spark.createDataFrame(ROWS, SCHEMA).withColumn("day", F.date_add(F.lit("2026-01-01").cast("date"), F.col("label")))
    columns = {"group_id": "group_id", "source_file": "source_file", "record_id": "record_id", "observed_at": "day"}
    found = lambda d, features=("x", "y"), **more: {(r["finding"], r["value"], r["blocker"]) for r in V.leakage_report(d, features, columns=columns, **more).collect()}
    clean = df.withColumns({"y": F.col("x") % 7, "day": F.lit("2026-01-01").cast("date")})
    assert found(clean) == set() and V.leakage_status(V.leakage_report(clean, ("x", "y"), columns=columns)).first()["status"] == "pass"
    got = found(df)
    assert {("label_derived_feature", "y", True), ("correlation_warning", "y:1.000000", False), ("unique_value_warning", "y", False), ("timestamp_warning", "2026-01-01", False), ("timestamp_warning", "2026-01-02", False)} == got
    leaks = clean.withColumns({"split": F.when(F.col("record_id") == 0, "test").otherwise(F.col("split")), "source_file": F.when(F.col("group_id") == 1, "DDoS-1").otherwise(F.col("source_file"))})
    assert {("group_overlap", "0", True), ("source_file_overlap", "f0", True), ("filename_leakage", "DDoS-1", True)} == found(leaks)
    twins = clean.union(clean.where("record_id = 0").withColumns({"record_id": F.lit(500).cast("long"), "split": F.lit("test"), "group_id": F.lit(4).cast("long"), "source_file": F.lit("f4")}))
    assert {f for f, _, _ in found(twins)} == {"exact_duplicate_overlap"}
    near = spark.createDataFrame([(1, 1), (4, 1)], "record_id long, component long")
    assert found(clean, near=near) == {("near_duplicate_overlap", "1", True)}
    assert ("suspicious_metadata", "group_id", True) in found(clean.withColumn("group_id", F.col("group_id").cast("double")), ("x", "group_id"))


def test_labels_are_looked_for_once(spark):
    """The report scans its rows for what goes with the label once, and not for each finding; tokens are plain text."""
    from flowlens.functions import scalars as S
    from flowlens.operators import dataset as D

    df = spark.createDataFrame(ROWS, SCHEMA)
    plan = V.leakage_report(df, ("x", "y"))._jdf.queryExecution().optimizedPlan().toString()
    assert "corr(" not in plan
    assert D.label_leakage(df.limit(0), ("x", "y"), "label").count() == 0
    mixed = spark.createDataFrame([(1, 1.0), (None, 1.0), (None, 2.0), (0, 3.0), (1, 3.0)], "label int, x double")
    assert [tuple(r) for r in D.label_leakage(mixed, ("x",), "label").select("copies_label", "deterministic").collect()] == [(False, False)]
    texts = spark.createDataFrame([("a DDOS here",), ("d.os",), ("dxos",), (None,)], "t string")
    assert [r[0] for r in texts.select(S.has_token(F.col("t"), ["ddos", "D.os"])).collect()] == [True, True, False, None]
    assert not texts.where(S.has_token(F.col("t"), [])).count()
