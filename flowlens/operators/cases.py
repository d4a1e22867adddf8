"""Analyst tables: latest feedback, transitions, case state, verdicts, retraining candidates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_feedback(feedback: DataFrame, keys: Sequence[str], updated: str, tie: str) -> DataFrame:
    """The newest row for each key."""
    w = Window.partitionBy(*keys).orderBy(F.desc(updated), F.desc(tie))
    return feedback.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def transition_violations(steps: DataFrame, key: str, order: str, status: str, allowed: Sequence[tuple[str, str]]) -> DataFrame:
    """(key, order, was, now) of steps whose change of status isn't allowed; a first step has none before it."""
    was = F.lag(status).over(Window.partitionBy(key).orderBy(order))
    fine = F.concat_ws(">", "was", "now").isin(*[f"{a}>{b}" for a, b in allowed])
    return steps.select(key, order, was.alias("was"), F.col(status).alias("now")).where(F.col("was").isNotNull() & ~fine)


def case_state(events: DataFrame, key: str, order: str, values: Sequence[str]) -> DataFrame:
    """The last value that isn't null of each field, per case."""
    return events.groupBy(key).agg(F.max(order).alias(order), *[F.max_by(v, F.when(F.col(v).isNotNull(), F.col(order))).alias(v) for v in values])


def set_verdict(alerts: DataFrame, verdicts: DataFrame) -> DataFrame:
    """alerts with the verdict replaced where verdicts (alert_id, new_verdict) has one; nothing else changes."""
    return alerts.join(verdicts, "alert_id", "left").withColumn("verdict", F.coalesce("new_verdict", "verdict")).drop("new_verdict")


#: verdict: label for retraining
LABELS = {"true_positive": "malicious", "false_positive": "benign", "benign_expected": "benign"}


def resolve_feedback(feedback: DataFrame, alerts: DataFrame, least_confidence: float = 0.7) -> DataFrame:
    """feedback with the first reason for which it is no candidate (null: it is one) and its label."""
    known = alerts.select(F.col("alert_id").alias("_a")).distinct()
    out = feedback.join(known, F.col("object_id") == F.col("_a"), "left")
    label = F.coalesce(*[F.when(F.col("verdict") == v, x) for v, x in LABELS.items()])
    reason = F.when(label.isNull(), "unmapped_verdict").when(F.col("confidence") < least_confidence, "low_confidence").when(F.col("object_id").isNull(), "invalid_id").when(F.col("_a").isNull(), "alert_missing")
    return out.withColumn("label", label).withColumn("reason", reason).drop("_a")


#: what telemetry has to say of its origin, and the partitions and types that may be trained on (fixed values of the policy)
ORIGIN = ("provenance_partition", "provenance_type", "dataset_id", "dataset_version", "scenario_id", "group_id")
ELIGIBLE = {"partitions": ("train", "feedback"), "excluded": ("test", "validation"), "types": ("analyst_review", "controlled_lab")}


def found_by(rows: DataFrame, key: str, others: DataFrame, other: str) -> DataFrame:
    """rows left-joined with others by equal keys, which are text; rows without a key, which find nothing, are spread over the tasks and not gathered in one."""
    marked = rows.withColumn("_by", F.when(F.col(key).isNull(), F.concat(F.lit("-"), F.xxhash64(*rows.columns).cast("string"))).otherwise(F.concat(F.lit("="), F.col(key))))
    return marked.join(others.withColumn("_by", F.concat(F.lit("="), F.col(other))), "_by", "left").drop("_by")


def resolve_candidates(feedback: DataFrame, alerts: DataFrame, detections: DataFrame, flows: DataFrame, sources: DataFrame, features: Sequence[str], least_confidence: float = 0.7, policy: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """feedback with label, flow_id and the first reason for which it is no candidate (null: it is one), along its chain of four equality joins.

    feedback is (feedback_id, object_type, object_id, verdict, confidence), object_id as text; alerts (alert_id, detection_id), detections (detection_id,
    flow_id), flows (flow_id, source_id, features) and sources (source_id, ORIGIN) have unique ids.
    """
    allowed = policy or ELIGIBLE
    one = lambda df, key, alias, *more: df.select(F.col(key).cast("string").alias(f"_{alias}"), *[F.col(c).cast("string").alias(f"_{c}") for c in more])
    a = one(alerts, "alert_id", "alert", "detection_id")
    d = one(detections, "detection_id", "detection", "flow_id")
    bad = F.lit(False)
    for f in features:
        bad = bad | F.isnan(f) | (F.abs(F.col(f)) == float("inf"))
    missing = F.lit(False)
    for f in features:
        missing = missing | F.col(f).isNull()
    f = flows.select(F.col("flow_id").cast("string").alias("_flow"), F.col("source_id").cast("string").alias("_source_id"), missing.alias("_missing"), bad.alias("_bad"))
    o = one(sources, "source_id", "source", *ORIGIN)
    chain = a
    for key, others, other in (("_detection_id", d, "_detection"), ("_flow_id", f, "_flow"), ("_source_id", o, "_source")):
        chain = found_by(chain, key, others, other)
    # feedback that has no alert is most of it: it is moved once, and not joined on with keys that it lacks
    out = found_by(feedback, "object_id", chain, "_alert")
    label = F.coalesce(*[F.when(F.col("verdict") == v, x) for v, x in LABELS.items()])
    gap = F.lit(False)
    for c in ORIGIN:
        gap = gap | F.coalesce(F.trim(f"_{c}") == "", F.lit(True))
    rules = (
        ("case_level", F.col("object_type") != "alert"),
        ("unmapped_verdict", label.isNull()),
        ("low_confidence", F.col("confidence") < least_confidence),
        ("invalid_id", F.coalesce(F.trim("object_id") == "", F.lit(True))),
        ("alert_missing", F.col("_alert").isNull()),
        ("detection_missing", F.col("_detection").isNull()),
        ("flow_missing", F.col("_flow").isNull()),
        ("features_incomplete", F.col("_missing")),
        ("features_not_finite", F.col("_bad")),
        ("source_missing", F.col("_source").isNull()),
        ("provenance_incomplete", gap),
        ("partition_excluded", F.col("_provenance_partition").isin(*allowed["excluded"])),
        ("partition_not_eligible", ~F.col("_provenance_partition").isin(*allowed["partitions"])),
        ("type_not_eligible", ~F.col("_provenance_type").isin(*allowed["types"])),
    )
    reason = F.coalesce(*[F.when(rule, name) for name, rule in rules])
    return out.select(*feedback.columns, label.alias("label"), F.col("_flow").alias("flow_id"), reason.alias("reason"))


def retraining_candidates(resolved: DataFrame) -> DataFrame:
    """Per object: its label, or conflict; the least confidence and the number of rows behind it."""
    out = resolved.where("reason is null").groupBy("object_id").agg(F.count_distinct("label").alias("labels"), F.min("label").alias("label"), F.min("confidence").alias("confidence"), F.count(F.lit(1)).alias("feedbacks"))
    return out.select("object_id", F.when(F.col("labels") > 1, "conflict").otherwise(F.col("label")).alias("label"), "confidence", "feedbacks")


def export_manifest(feedback: DataFrame) -> DataFrame:
    return feedback.groupBy("verdict").agg(F.count(F.lit(1)).alias("n"), F.min("feedback_id").alias("first_id"), F.max("feedback_id").alias("last_id"))


def append_new(new: DataFrame, existing: DataFrame, key: str, evidence: Column) -> DataFrame:
    """new with outcome: inserted, reused (same evidence is there) or conflict (other evidence is there)."""
    have = existing.select(F.col(key).alias("_k"), evidence.alias("_e")).dropDuplicates(["_k"])
    out = new.withColumn("_n", evidence).join(have, F.col(key) == F.col("_k"), "left")
    return out.withColumn("outcome", F.when(F.col("_k").isNull(), "inserted").when(F.col("_n") == F.col("_e"), "reused").otherwise("conflict")).drop("_n", "_e", "_k")


def timeline(audit: DataFrame, feedback: DataFrame, notes: DataFrame, case: str) -> DataFrame:
    """One case's rows (at, kind, actor) of three tables: a union of three equality filters rather than a join on alternatives."""
    pick = lambda df, kind: df.where(F.col("case_id") == case).select("at", F.lit(kind).alias("kind"), "actor")
    return pick(audit, "audit").unionByName(pick(feedback, "feedback")).unionByName(pick(notes, "note")).distinct()


def audit_projection(events: DataFrame, json_col: str, length: int = 40, secret: str = "token|secret|password") -> DataFrame:
    """events with details: the JSON object's fields without sensitive names, values cut to a length."""
    fields = F.from_json(json_col, "map<string,string>")
    kept = F.transform_values(F.map_filter(fields, lambda k, _: ~F.lower(k).rlike(secret)), lambda _, v: F.left(v, F.lit(length)))
    return events.withColumn("details", F.to_json(kept))


def case_facts(cases: DataFrame, references: DataFrame, notes: DataFrame, feedback: DataFrame, audit: DataFrame) -> DataFrame:
    """(case_id, section, at, id, detail): what a case's report lists, a row for each fact, so that no case is gathered whole.

    cases is (case_id, alert_ids, first_seen, last_seen, verdict); references, notes and audit are (case_id or object_id, id, at,
    detail), feedback (id, object_type, object_id, at, detail). Feedback counts that is on the case or on one of its alerts, once for each case; audit
    rows are those of the case and of that feedback. Ids are compared as text.
    """
    key = cases.select(F.col("case_id").cast("string").alias("case_id"), "alert_ids", "first_seen", "last_seen", "verdict")
    shape = lambda df, section: df.select("case_id", F.lit(section).alias("section"), "at", F.col("id").cast("string").alias("id"), F.col("detail").cast("string").alias("detail"))
    window = key.select("case_id", F.lit("case").alias("section"), F.col("first_seen").alias("at"), F.col("case_id").alias("id"), F.concat_ws("|", F.col("last_seen").cast("string"), "verdict").alias("detail"))
    own = lambda df: df.withColumn("case_id", F.col("case_id").cast("string")).join(key.select("case_id"), "case_id")
    targets = key.select("case_id", F.lit("case").alias("object_type"), F.col("case_id").alias("object_id")).unionByName(key.select("case_id", F.lit("alert").alias("object_type"), F.explode(F.col("alert_ids").cast("array<string>")).alias("object_id")))
    said = feedback.withColumn("object_id", F.col("object_id").cast("string")).join(targets.distinct(), ["object_type", "object_id"]).select("case_id", "at", "id", "detail").distinct()
    watched = key.select("case_id", F.col("case_id").alias("object_id")).unionByName(said.select("case_id", F.col("id").cast("string").alias("object_id"))).distinct()
    seen = audit.withColumn("object_id", F.col("object_id").cast("string")).join(watched, "object_id").select("case_id", "at", "id", "detail").distinct()
    parts = [shape(own(references), "reference"), shape(own(notes), "note"), shape(said, "feedback"), shape(seen, "audit")]
    out = window
    for p in parts:
        out = out.unionByName(p)
    return out
