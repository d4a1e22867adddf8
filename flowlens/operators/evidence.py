"""Snapshots of referenced objects, frozen inventories of splits and the report on leakage."""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.functions.scalars import fingerprint, has_token
from flowlens.operators.dataset import label_leakage, overlap
from flowlens.operators.tables import stored

#: kinds of objects that evidence may refer to, and what a snapshot leaves out
KINDS = ("threat_hypothesis", "alert_group", "security_alert", "detection_result", "network_flow")
TRUTH = ("ground_truth_label", "attack_family", "label")


@F.pandas_udf(T.StringType())
def canonical_json(text: pd.Series) -> pd.Series:
    """JSON with sorted keys, without spaces, other than ASCII escaped, numbers as Python writes them."""
    return text.map(lambda x: None if x is None else json.dumps(json.loads(x), sort_keys=True, separators=(",", ":")))


def resolve_evidence(references: DataFrame, tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """references (object_type, object_id, ...) with snapshot, its SHA-256 and status: resolved, missing or unknown_type.

    tables has for each kind its rows and their id column. One equi join on (type, id) finds the objects; only those are
    written out. Nulls stay in a snapshot, labels of flows don't.
    """
    unknown = sorted(set(tables) - set(KINDS))
    if unknown:
        raise ValueError(f"no kinds of evidence: {unknown}")
    objects = [
        rows.select(F.lit(kind).alias("object_type"), F.col(id_col).cast("string").alias("object_id"), F.to_json(F.struct(*[c for c in sorted(rows.columns) if kind != "network_flow" or c not in TRUTH]), {"ignoreNullFields": "false"}).alias("_raw"))
        for kind, (rows, id_col) in tables.items()
    ]
    there = reduce(DataFrame.unionByName, objects)
    found = references.withColumn("object_id", F.col("object_id").cast("string")).join(there, ["object_type", "object_id"], "left")
    status = F.when(~F.col("object_type").isin(*tables), "unknown_type").when(F.col("_raw").isNull(), "missing").otherwise("resolved")
    found = found.withColumns({"status": status, "snapshot": canonical_json("_raw")}).drop("_raw")
    return found.withColumn("checksum", F.sha2("snapshot", 256))


def row_digest(columns: Sequence[str]) -> Column:
    """Digest of a row: its values as text, by their lengths, so that no two rows run together."""
    parts = [F.coalesce(F.concat_ws(":", F.length(F.col(c).cast("string")).cast("string"), F.col(c).cast("string")), F.lit("-")) for c in columns]
    return F.sha2(F.concat_ws(",", *parts), 256)


def split_inventory(rows: DataFrame, split: str, group: str, label: str, columns: Sequence[str]) -> DataFrame:
    """(split, n, groups, attacks, digest): what a split holds. The digest is the sum of 52 bits of each row's, whatever their order."""
    bits = F.conv(F.substring(row_digest(columns), 1, 13), 16, 10).cast("decimal(38,0)")
    return rows.groupBy(F.col(split).alias("split")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(group).alias("groups"), F.sum(label).cast("long").alias("attacks"), F.sum(bits).cast("string").alias("digest"))


def gate_violations(rows: DataFrame, split: str, group: str, label: str, columns: Sequence[str], frozen: DataFrame, selection_status: str = "frozen", test_seen: bool = False) -> DataFrame:
    """(split, rule) for whatever keeps the test rows shut: a selection that isn't frozen or has seen them, splits that are missing,
    extra or hold other rows, groups or attacks than the frozen inventory, and groups in more than one split."""
    now = split_inventory(rows, split, group, label, columns)
    both = now.alias("a").join(frozen.alias("b"), "split", "full")
    differs = lambda c: ~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    rules = F.when(F.col("b.n").isNull(), F.array(F.lit("extra_split"))).when(F.col("a.n").isNull(), F.array(F.lit("missing_split"))).otherwise(F.array_compact(F.array(*[F.when(differs(c), F.lit(f"{c}_differ")) for c in ("n", "groups", "attacks", "digest")])))
    found = both.select("split", F.explode(rules).alias("rule"))
    shared = overlap(rows.withColumnRenamed(split, "split") if split != "split" else rows, group)
    found = found.unionByName(shared.limit(1).select(F.lit("all").alias("split"), F.lit("group_overlap").alias("rule")))
    state = [("test", rule) for rule, bad in (("selection_not_frozen", selection_status != "frozen"), ("test_seen", test_seen)) if bad]
    return found.unionByName(rows.sparkSession.createDataFrame(state, "split string, rule string")) if state else found


def changed_rows(rows: DataFrame, frozen: DataFrame, id_col: str, split: str, columns: Sequence[str]) -> DataFrame:
    """(id, rule) of rows that aren't as the frozen row inventory (id, split, digest, copies) has them: changed, moved, missing, extra.

    Rows that repeat an id count by content, so that a lost or added copy is named as well.
    """
    now = row_inventory(rows, id_col, split, columns)
    key = ["id", "split", "digest"]
    both = now.join(frozen.withColumnRenamed("copies", "were"), key, "full").withColumn("more", F.coalesce("copies", F.lit(0)) - F.coalesce("were", F.lit(0))).where("more <> 0")
    per = both.groupBy("id").agg(F.sum(F.greatest("more", F.lit(0))).alias("added"), F.sum(F.greatest(-F.col("more"), F.lit(0))).alias("gone"), F.count_distinct("digest").alias("contents"))
    rule = F.when(F.col("gone") == 0, "extra").when(F.col("added") == 0, "missing").when(F.col("contents") == 1, "moved").otherwise("changed")
    return per.select("id", rule.alias("rule"))


def row_inventory(rows: DataFrame, id_col: str, split: str, columns: Sequence[str]) -> DataFrame:
    return rows.groupBy(F.col(id_col).cast("string").alias("id"), F.col(split).alias("split"), row_digest(columns).alias("digest")).agg(F.count(F.lit(1)).alias("copies"))


#: tokens that give a label away (fixed values of the format)
LABEL_TOKENS = ("attack", "benign", "malicious", "scan", "brute", "ddos", "dos", "bot", "infiltration", "exfiltration", "ransomware")
#: columns of a row's metadata, which no feature may be (fixed values of the format)
METADATA = ("dataset_id", "dataset_version", "record_id", "source_file", "source_file_checksum", "capture_session_id", "scenario_id", "group_id", "original_row_id", "observed_at", "ground_truth_label", "binary_label", "attack_family", "original_label")
BLOCKERS = ("group_overlap", "source_file_overlap", "session_overlap", "scenario_overlap", "exact_duplicate_overlap", "near_duplicate_overlap", "label_derived_feature", "suspicious_metadata", "filename_leakage", "record_id_leakage")


def leakage_report(assigned: DataFrame, features: Sequence[str], label: str = "label", columns: dict[str, str] | None = None, near: DataFrame | None = None) -> DataFrame:
    """(finding, value, blocker): all that lets labels or splits leak, over rows with their split.

    columns names what the rows have of group_id, source_file, capture_session_id, scenario_id, record_id and observed_at. near is
    (record_id, component) of near duplicates. Blockers fail the report; correlated or deterministic features, and dates with one label among several dates, are warnings.
    """
    has = columns or {}
    named = lambda finding, df: df.select(F.lit(finding).alias("finding"), F.col("value").cast("string").alias("value"))
    parts = [named(f"{name}_overlap", overlap(assigned, has[c])) for name, c in (("group", "group_id"), ("source_file", "source_file"), ("session", "capture_session_id"), ("scenario", "scenario_id")) if c in has]
    parts.append(named("exact_duplicate_overlap", overlap(assigned.withColumn("_print", fingerprint([F.col(f) for f in features])), "_print")))
    if near is not None:
        spans = assigned.select(F.col(has["record_id"]).alias("record_id"), "split").join(near, "record_id")
        parts.append(named("near_duplicate_overlap", overlap(spans, "component")))
    # a row for each feature, asked three times
    linked = stored(label_leakage(assigned, features, label), "linked")
    tokens = "|".join(LABEL_TOKENS)
    parts.append(named("label_derived_feature", linked.where(F.col("copies_label") | F.lower("feature").rlike(tokens)).withColumn("value", F.col("feature"))))
    spark = assigned.sparkSession
    meta = [(f,) for f in features if f in METADATA]
    if meta:
        parts.append(named("suspicious_metadata", spark.createDataFrame(meta, "value string")))
    for finding, c in (("filename_leakage", "source_file"), ("record_id_leakage", "record_id")):
        if c in has:
            parts.append(named(finding, assigned.select(F.col(has[c]).cast("string").alias("value")).where(has_token(F.col("value"), LABEL_TOKENS)).distinct()))
    parts.append(named("correlation_warning", linked.where("correlated").withColumn("value", F.format_string("%s:%.6f", "feature", "r"))))
    parts.append(named("unique_value_warning", linked.where("deterministic").withColumn("value", F.col("feature"))))
    if "observed_at" in has:
        days = assigned.groupBy(F.to_date(has["observed_at"]).cast("string").alias("value")).agg(F.count_distinct(label).alias("labels")).where("value is not null and labels > 0")
        days = days.withColumn("days", F.count(F.lit(1)).over(Window.partitionBy()))
        parts.append(named("timestamp_warning", days.where("days > 1 and labels = 1")))
    return reduce(DataFrame.unionByName, parts).withColumn("blocker", F.col("finding").isin(*BLOCKERS))


def leakage_status(report: DataFrame) -> DataFrame:
    """(status, blockers, warnings): fail where any blocker has been found."""
    return report.agg(F.when(F.count_if("blocker") > 0, "fail").otherwise("pass").alias("status"), F.count_if("blocker").alias("blockers"), F.count_if(~F.col("blocker")).alias("warnings"))
