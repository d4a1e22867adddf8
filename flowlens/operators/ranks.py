"""Exact quantiles and whole-table ranks without a task that holds a whole column: counts by stretch, then places within a stretch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: stretches that the values of a key are cut into
STRETCHES = 64
#: rows of a table that one bucket of ranks holds on average
BUCKET_ROWS = 20_000


def exact_quantiles(counts: DataFrame, by: Sequence[str], probabilities: dict[str, float]) -> DataFrame:
    """(by, n, a column for each probability) of counts (by, value, c) with distinct values: linear between order statistics; nulls don't count.

    The values of a key are cut at approximate quantiles. The stretches' sums say how many values come before each, running sums
    within a stretch give each distinct value its places, and the few values at wanted places are picked by a partial aggregate.
    """
    there = counts.where("value is not null")
    cuts = there.groupBy(*by).agg(F.percentile_approx("value", [i / STRETCHES for i in range(1, STRETCHES)], 1000).alias("cuts"))
    placed = there.join(cuts, list(by)) if by else there.crossJoin(cuts)
    placed = placed.withColumn("stretch", F.size(F.filter("cuts", lambda x: x < F.col("value")))).drop("cuts")
    key = [*by, "stretch"]
    sums = placed.groupBy(*key).agg(F.sum("c").alias("s"))
    whole = Window.partitionBy(*by)
    sums = sums.withColumns({"before": F.coalesce(F.sum("s").over(whole.orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "n": F.sum("s").over(whole)}).drop("s")
    run = F.sum("c").over(Window.partitionBy(*key).orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    ranked = placed.withColumn("run", run).join(sums, key).withColumns({"end": F.col("before") + F.col("run"), "start": F.col("before") + F.col("run") - F.col("c")})
    at = {name: (F.col("n") - 1) * F.lit(float(p)) for name, p in probabilities.items()}
    holds = lambda place: (F.col("start") <= place) & (place < F.col("end"))
    picks = [F.max(F.when(holds(side(place)), F.col("value"))).alias(f"_{side.__name__}_{name}") for name, place in at.items() for side in (F.floor, F.ceil)]
    out = ranked.groupBy(*by).agg(F.first("n").alias("n"), *picks)

    def between(name: str, place: Column) -> Column:
        low, high = F.col(f"_floor_{name}"), F.col(f"_ceil_{name}")
        # between equal values this is that value to the last bit, so that none of them is above it
        return F.when((low == high) | (low == float("-inf")), low).otherwise(low + (high - low) * (place - F.floor(place)))

    return out.select(*by, "n", *[between(name, place).alias(name) for name, place in at.items()])


def value_counts(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """(by, value, c): distinct values with their numbers."""
    return rows.groupBy(*by, F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("c"))


def hash_ranks(rows: DataFrame, by: Sequence[str], digest: Column, n: int, out: str) -> DataFrame:
    """rows with out: its place from 0 among its key's rows in the order of a hexadecimal digest, which has to be of its own for each row of a key.

    Digests are uniform, so that buckets of their first digits are even; each starts after the sum of those before it.
    """
    digits = next(k for k in range(9) if 16**k * BUCKET_ROWS >= n or k == 8)
    rows = rows.withColumn("_digest", digest).withColumn("_bucket", F.left("_digest", F.lit(digits)))
    sums = rows.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_s"))
    before = F.sum("_s").over(Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select(*by, "_bucket", F.coalesce(before, F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy(*by, "_bucket").orderBy("_digest")) - 1
    return rows.withColumn("_place", place).join(sums, [*by, "_bucket"]).withColumn(out, F.col("_before") + F.col("_place")).drop("_digest", "_bucket", "_before", "_place")
