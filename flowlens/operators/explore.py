"""Reading flows, detections and alerts: filters, joins, pages, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def filter_flows(flows: DataFrame, detections: DataFrame | None = None, alerts: DataFrame | None = None, **by) -> DataFrame:
    """Flows that meet every given condition: source, protocol, source_ip, destination_ip, first_from, last_to, label, has_alert, risk, anomaly.

    Detections and alerts are joined only when a condition needs them.
    """
    same = {"source": "source_id", "protocol": "protocol", "source_ip": "source_ip", "destination_ip": "destination_ip", "label": "label"}
    for k, column in same.items():
        if k in by:
            flows = flows.where(F.col(column) == by[k])
    if "first_from" in by:
        flows = flows.where(F.col("first_seen") >= by["first_from"])
    if "last_to" in by:
        flows = flows.where(F.col("last_seen") <= by["last_to"])
    if "risk" in by or "anomaly" in by:
        scored = detections
        for k, column in (("risk", "supervised"), ("anomaly", "anomaly")):
            if k in by:
                scored = scored.where(F.col(column) >= by[k])
        flows = flows.join(scored.select("flow_id"), "flow_id", "left_semi")
    if "has_alert" in by:
        flows = by_alert_presence(flows, alerts, by["has_alert"])
    return flows


def by_alert_presence(flows: DataFrame, alerts: DataFrame, present: bool) -> DataFrame:
    return flows.join(alerts.select(F.col("alert_id").alias("flow_id")), "flow_id", "left_semi" if present else "left_anti")


def with_detection(flows: DataFrame, detections: DataFrame) -> DataFrame:
    return flows.join(detections.drop("label"), "flow_id")


def in_job_scope(rows: DataFrame, ledger: DataFrame, job_id: int) -> DataFrame:
    return rows.join(ledger.where(F.col("job_id") == job_id).select("flow_id"), "flow_id", "left_semi")


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """A stable page; the sort keeps no more than offset + limit rows a task."""
    return df.orderBy(*order).offset(offset).limit(limit)


def flow_summary(flows: DataFrame) -> DataFrame:
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return flows.agg(F.count(F.lit(1)).alias("flows"), zero("packets").alias("packets"), zero("bytes").alias("bytes"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))


def top_pairs(flows: DataFrame, k: int = 20) -> DataFrame:
    return flows.groupBy("source_ip", "destination_ip").agg(F.count(F.lit(1)).alias("flows")).orderBy(F.desc("flows"), "source_ip", "destination_ip").limit(k)


def score_histogram(scores: DataFrame, column: str) -> DataFrame:
    """Ten buckets on [0, 1], the last closed, zero-filled; scores outside are in none."""
    inside = scores.where(F.col(column).between(0, 1)).groupBy(F.least(F.floor(F.col(column) * 10), F.lit(9)).cast("long").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    buckets = scores.sparkSession.range(10).withColumnRenamed("id", "bucket")
    return buckets.join(inside, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


def job_statistics(ledger: DataFrame, alerts: DataFrame) -> DataFrame:
    """Per job: distinct flows, distinct alerts and alerts a flow (null without flows)."""
    joined = ledger.join(alerts.select(F.col("alert_id").alias("a")), F.col("flow_id") == F.col("a"), "left")
    out = joined.groupBy("job_id").agg(F.count_distinct("flow_id").alias("flows"), F.count_distinct("a").alias("alerts"))
    return out.withColumn("alert_rate", F.round(F.col("alerts") / F.nullif("flows", F.lit(0)), 6))
