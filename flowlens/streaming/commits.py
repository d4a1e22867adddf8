"""Micro-batches whose tables are visible together or not at all, and incremental correlation on top of them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from flowlens.operators.correlate import eligible_alerts, merged_groups, observed_entities, ruled_clusters


class BatchConflict(ValueError):
    """A batch has been committed with other rows."""


def _files(spark: SparkSession, path: str) -> tuple[object, object]:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), place


def content_digest(df: DataFrame) -> tuple[int, str]:
    """(rows, digest) of a table, whatever its order: sums of two hashes of each row, added up by partial aggregates."""
    columns = [F.col(f"`{c}`") for c in sorted(df.columns)]
    sums = [F.sum(F.xxhash64(F.lit(seed), *columns).cast("decimal(38,0)")) for seed in (1, 2)]
    row = df.agg(F.count(F.lit(1)), *sums).first()
    return row[0], f"{row[0]}:{row[1] or 0}:{row[2] or 0}"


def commit_batch(spark: SparkSession, root: str, batch: int, tables: dict[str, DataFrame], counters: dict[str, int] | None = None) -> str:
    """Writes tables and a ledger of their digests aside and renames the folder into place: ``created``.

    A batch that is there already with the same digests is ``reused``; with others, BatchConflict. A killed
    attempt leaves its folder in ``staging`` only, which no reader looks into.
    """
    staging, final = f"{root}/staging/{batch}-{uuid.uuid4().hex}", f"{root}/batches/batch={batch}"
    digests = {}
    for name, df in tables.items():
        df.write.parquet(f"{staging}/{name}")
        digests[name] = content_digest(spark.read.schema(df.schema).parquet(f"{staging}/{name}"))
    ledger = [(name, n, digest) for name, (n, digest) in digests.items()] + [(f"counter:{k}", int(v), "") for k, v in (counters or {}).items()]
    spark.createDataFrame(ledger, "name string, n long, digest string").coalesce(1).write.parquet(f"{staging}/ledger")
    files, place = _files(spark, final)
    if files.exists(place):
        there = {r["name"]: r["digest"] for r in spark.read.parquet(f"{final}/ledger").collect() if r["digest"]}
        files.delete(_files(spark, staging)[1], True)
        if there != {name: digest for name, (_, digest) in digests.items()}:
            raise BatchConflict(f"batch {batch} was committed with other rows")
        return "reused"
    files.mkdirs(place.getParent())
    if not files.rename(_files(spark, staging)[1], place):
        raise BatchConflict(f"batch {batch} can't be moved into place")
    return "created"


def batches_of(spark: SparkSession, root: str) -> list[int]:
    files, place = _files(spark, f"{root}/batches")
    return sorted(int(f.getPath().getName().split("=")[1]) for f in files.listStatus(place)) if files.exists(place) else []


def committed(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    """All committed rows of a table, with the batch that they came in."""
    found = [f"{root}/batches/batch={b}/{name}" for b in batches_of(spark, root)]
    if not found:
        return spark.createDataFrame([], f"{schema}, batch long")
    rows = spark.read.schema(schema).parquet(*found)
    return rows.withColumn("batch", F.regexp_extract(F.input_file_name(), r"/batch=(\d+)/", 1).cast("long"))


def score_in_batches(flows: DataFrame, root: str, checkpoint: str, detect: Callable[[DataFrame], DataFrame], alerts: Callable[[DataFrame, DataFrame], DataFrame], ordered: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Starts a query that scores ended flows batch by batch; detections, alerts and ledger of a batch come into sight together.

    detect gives a detection for each flow, alerts (detections, flows) those that call for one. After a restart Spark
    gives a batch the id that it had; its rows are derived again and found to be the same.
    """

    def take(df: DataFrame, batch: int) -> None:
        spark = df.sparkSession
        df = df.persist()
        try:
            found = detect(df).persist()
            raised = alerts(found, df)
            late, n = df.agg(F.coalesce(F.sum("late"), F.lit(0)), F.count(F.lit(1))).first() if "late" in df.columns else (0, df.count())
            commit_batch(spark, root, batch, {"detections": found, "alerts": raised}, {"flows": n, "late_packets": late})
            found.unpersist()
        finally:
            df.unpersist()

    return flows.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


MEMBERS = "entity string, alert_id string, event_start long, event_end long"
CLUSTERS = "entity string, cluster long, members array<string>, rules array<string>"
GROUPS = "group_id string, members array<string>, entities array<string>, rules array<string>, alerts long, risk double, reasons long, codes array<string>, first_seen long, last_seen long, score double, severity string"
FACTS = "alert_id string, source_ip string, destination_ip string, event_start long, event_end long, risk double, alert_type string, reason string, verdict string"


def latest(rows: DataFrame, marks: DataFrame, key: str) -> DataFrame:
    """The rows of each key's latest batch; marks (key, batch) also name keys that have none left in it."""
    last = marks.groupBy(key).agg(F.max("batch").alias("batch"))
    return rows.join(last, [key, "batch"]).drop("batch")


def correlate_batch(spark: SparkSession, root: str, batch: int, new: DataFrame, seconds: float, least_score: float = 0.35) -> DataFrame:
    """Takes new alerts (the columns of FACTS) in and returns (group_id, outcome) of the groups that they touch: created, changed, reused or retired.

    Only entities of the new alerts are folded again, over all their alerts; of groups, only those whose members are in an old or new
    cluster of such an entity. A group's id is a digest of its members, so that after any batches the groups are those of all alerts at once.
    Alerts that are known already are left out; a batch that was committed before is left as it is.
    """
    if batch in batches_of(spark, root):
        return committed(spark, root, "outcomes", "group_id string, outcome string").where(F.col("batch") == batch).drop("batch")
    read = lambda name, schema: committed(spark, root, name, schema)
    known = read("alerts", FACTS).drop("batch")
    fresh = eligible_alerts(new.withColumn("alert_id", F.col("alert_id").cast("string"))).select(*[c.split()[0] for c in FACTS.split(", ")]).dropDuplicates(["alert_id"]).join(known.select("alert_id"), "alert_id", "left_anti").persist()
    members = observed_entities(fresh).join(fresh.select("alert_id", "event_start", "event_end"), "alert_id").select(*[c.split()[0] for c in MEMBERS.split(", ")]).persist()
    touched = members.select("entity").distinct().persist()
    alerts = known.unionByName(fresh)
    folded = read("members", MEMBERS).drop("batch").unionByName(members).join(touched, "entity", "left_semi")
    clusters = ruled_clusters(folded, alerts, seconds).select(*[c.split()[0] for c in CLUSTERS.split(", ")]).persist()
    stored = latest(read("clusters", CLUSTERS), read("touched", "entity string"), "entity").persist()
    changed = stored.join(touched, "entity", "left_semi").select("members").unionByName(clusters.select("members")).distinct()
    after = stored.join(touched, "entity", "left_anti").unionByName(clusters).join(changed, "members", "left_semi")
    group_id = F.sha2(F.to_json(F.struct("members")), 256)
    groups = merged_groups(after, alerts, seconds, least_score).withColumn("group_id", group_id).select(*[c.split()[0] for c in GROUPS.split(", ")]).persist()
    marks = changed.select(group_id.alias("group_id")).persist()
    content = F.sha2(F.to_json(F.struct(*[c.split()[0] for c in GROUPS.split(", ")])), 256)
    before = latest(read("groups", GROUPS), read("marks", "group_id string"), "group_id").join(marks, "group_id", "left_semi")
    both = before.select("group_id", content.alias("was")).join(groups.select("group_id", content.alias("now")), "group_id", "full")
    outcome = F.when(F.col("was").isNull(), "created").when(F.col("now").isNull(), "retired").when(F.col("was") == F.col("now"), "reused").otherwise("changed")
    outcomes = both.select("group_id", outcome.alias("outcome"))
    commit_batch(spark, root, batch, {"alerts": fresh, "members": members, "touched": touched, "clusters": clusters, "groups": groups, "marks": marks, "outcomes": outcomes})
    for df in (fresh, members, touched, clusters, stored, groups, marks):
        df.unpersist()
    return committed(spark, root, "outcomes", "group_id string, outcome string").where(F.col("batch") == batch).drop("batch")


def current_groups(spark: SparkSession, root: str) -> DataFrame:
    return latest(committed(spark, root, "groups", GROUPS), committed(spark, root, "marks", "group_id string"), "group_id")


def progress(spark: SparkSession, root: str) -> DataFrame:
    """(name, n): counters and rows of all committed batches."""
    ledgers = committed(spark, root, "ledger", "name string, n long, digest string")
    return ledgers.groupBy("name").agg(F.sum("n").alias("n"))


def correlate_in_batches(alerts: DataFrame, root: str, checkpoint: str, seconds: float) -> StreamingQuery:
    return alerts.writeStream.foreachBatch(lambda df, batch: correlate_batch(df.sparkSession, root, batch, df, seconds)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
