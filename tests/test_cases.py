from pyspark.sql import functions as F

from flowlens.operators import cases as C


def test_rows_without_a_key_are_not_one_task(spark):
    rows = spark.range(4000).select("id", F.when(F.col("id") % 100 == 0, F.col("id").cast("string")).alias("key"))
    others = spark.range(0, 4000, 200).select(F.col("id").cast("string").alias("other"), F.lit(1).alias("there"))
    found = C.found_by(rows, "key", others.hint("merge"), "other")
    got = {r["id"]: r["there"] for r in found.collect()}
    assert got == {i: 1 if i % 200 == 0 else None for i in range(4000)}
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = [r["count"] for r in C.found_by(rows, "key", others.hint("merge"), "other").groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert max(sizes) < 4000 / 4 * 1.3


def test_feedback_moves_once(spark, sf):
    """Feedback without an alert, most of it, isn't joined again by the keys that it lacks."""
    from flowlens.queries import QUERIES

    plan = QUERIES["join7_resolve_feedback"](spark, sf)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    joins = [i for i, line in enumerate(plan) if "Join LeftOuter" in line and "_by" in line]
    read = next(i for i, line in enumerate(plan) if "event_id" in line and "Relation" in line)
    # the first join is that of feedback, the others are below its other side
    assert len(joins) == 4 and joins[0] < read < joins[1]
