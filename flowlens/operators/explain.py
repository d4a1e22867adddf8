"""How scores depend on features: replacement by a reference, permutation over the whole table, splits of trees."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.operators.ranks import exact_quantiles, hash_ranks, value_counts

#: deltas up to this are neutral
NEUTRAL = 1e-12
PROFILE = {"q05": 0.05, "q25": 0.25, "median": 0.5, "q75": 0.75, "q95": 0.95}


def reference_profile(benign: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature, i, n, lo, q05, q25, median, q75, q95, hi) of benign training rows; i counts features from 0."""
    long = benign.unpivot([], list(features), "feature", "value")
    counts = value_counts(long, ["feature"], "value")
    ends = counts.groupBy("feature").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    place = F.array_position(F.array(*[F.lit(f) for f in features]), F.col("feature")) - 1
    return exact_quantiles(counts, ["feature"], PROFILE).join(ends, "feature").select("feature", place.cast("int").alias("i"), "n", "lo", *PROFILE, "hi")


def profile_violations(rows: DataFrame, split: str, label: str) -> DataFrame:
    """(rule, n) of rows that a reference profile may not be made of: other splits than train, attacks."""
    rules = {"not_train": F.col(split) != "train", "attack": F.col(label) == 1}
    counts = rows.agg(*[F.count_if(F.coalesce(c, F.lit(True))).alias(r) for r, c in rules.items()])
    return counts.unpivot([], list(rules), "rule", "n").where("n > 0")


def in_flows(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """(id, risk, observed, x: structs of i and replaced risk) of scored rows (id, i, risk, observed), n + 1 in a row for each flow, i from -1."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        held.append(batch)
        count += batch.num_rows
        if count <= n:
            continue
        rows = pa.Table.from_batches(held).combine_chunks()
        whole = count - count % (n + 1)
        held, count = rows.slice(whole).to_batches(), count - whole
        rows = rows.slice(0, whole).combine_chunks()
        i = rows["i"].to_numpy().reshape(-1, n + 1)
        if (i != np.arange(-1, n)).any():
            raise ValueError("the score moves or drops rows")
        flows = len(i)
        risk = rows["risk"].combine_chunks()
        at = np.arange(whole).reshape(-1, n + 1)
        first, rest = pa.array(at[:, 0]), pa.array(at[:, 1:].ravel())
        replaced = pa.StructArray.from_arrays([pa.array(np.tile(np.arange(n, dtype=np.int32), flows)), risk.take(rest)], ["i", "replaced"])
        x = pa.ListArray.from_arrays(pa.array(np.arange(flows + 1, dtype=np.int32) * n), replaced)
        yield pa.RecordBatch.from_arrays([rows[0].combine_chunks().take(first), risk.take(first), rows["observed"].combine_chunks().take(first), x], [rows.schema.names[0], "risk", "observed", "x"])
    if count:
        raise ValueError("the score moves or drops rows")


def local_contributions(flows: DataFrame, id_col: str, features: Sequence[str], profile: DataFrame, score: Callable[[DataFrame], DataFrame], k: int = 5) -> DataFrame:
    """(id, contributions): the k features whose replacement by the profile's median changes the risk most, ties by feature order.

    score adds ``risk`` to rows of features, row by row: it may not move or drop any. A flow becomes a row as it is and one for each
    feature replaced, scored in one pass and put together again where they are, without a shuffle. A contribution is (feature, observed, median, low, high, risk, replaced_risk, delta, direction); deltas up to NEUTRAL are 0 and neutral.
    """
    names = list(features)
    # one row a feature
    known = {r["feature"]: r for r in profile.select("feature", "q05", "median", "q95").collect()}
    missing = [f for f in names if f not in known]
    if missing:
        raise ValueError(f"the profile lacks {missing}")
    copies = flows.select(id_col, *names, F.explode(F.sequence(F.lit(-1), F.lit(len(names) - 1))).alias("i"))
    replaced = [F.when(F.col("i") == i, F.lit(float(known[f]["median"]))).otherwise(F.col(f)).alias(f) for i, f in enumerate(names)]
    # the row as it is brings what was observed
    whole = F.when(F.col("i") < 0, F.array(*[F.col(f).cast("double") for f in names])).alias("observed")
    scored = score(copies.select(id_col, "i", *replaced)).select(id_col, "i", "risk", whole)
    kind = flows.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, risk double, observed array<double>, x array<struct<i: int, replaced: double>>"
    both = scored.select(id_col, F.col("i").cast("int").alias("i"), F.col("risk").cast("double").alias("risk"), "observed").mapInArrow(lambda batches: in_flows(batches, len(names)), schema)
    delta = lambda x: F.when(F.abs(F.col("risk") - x["replaced"]) <= NEUTRAL, 0.0).otherwise(F.col("risk") - x["replaced"])
    at = lambda what, x: F.get(F.lit([float(known[f][what]) for f in names]), x["i"])
    way = lambda d: F.when(d > 0, "increases_suspicion").when(d < 0, "decreases_suspicion").otherwise("neutral")
    ranked = F.slice(F.array_sort(F.transform("x", lambda x: F.struct((-F.abs(delta(x))).alias("order"), x["i"].alias("i"), x["replaced"].alias("replaced")))), 1, k)
    shown = F.transform(
        "ranked",
        lambda x: F.struct(
            F.get(F.array(*[F.lit(f) for f in names]), x["i"]).alias("feature"), F.get("observed", x["i"]).alias("observed"), at("median", x).alias("median"), at("q05", x).alias("low"), at("q95", x).alias("high"),
            F.col("risk").alias("risk"), x["replaced"].alias("replaced_risk"), delta(x).alias("delta"), way(delta(x)).alias("direction"),
        ),
    )
    return both.select(id_col, "risk", "observed", ranked.alias("ranked")).select(id_col, shown.alias("contributions"))


def permuted(rows: DataFrame, id_col: str, features: Sequence[str], repeats: int, seed: int) -> DataFrame:
    """rows once for each feature and repeat (columns feature, repeat), that feature's values permuted over the whole table.

    The row at a place in one order of hashes gets the value of the row at that place in another; places come from even
    buckets of hashes, so that no task sees a whole column. Rows that repeat an id share a hash and may change places.
    """
    names, n = list(features), rows.count()
    grid = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(r).alias("repeat")) for f in names for r in range(repeats)])).alias("g")
    digest = lambda kind: F.sha2(F.concat_ws(":", F.lit(f"{seed}"), F.lit(kind), *([F.col("feature"), F.col("repeat")] if kind else []), F.col(id_col).cast("string")), 256)
    value = F.coalesce(*[F.when(F.col("feature") == f, F.col(f).cast("double")) for f in names])
    each = rows.select(id_col, *names, grid).select(id_col, "g.*", value.alias("value"))
    given = hash_ranks(each, ["feature", "repeat"], digest("from"), n, "place").select("feature", "repeat", "place", "value")
    taking = hash_ranks(rows, [], digest(""), n, "place")
    out = taking.join(given, "place").drop("place")
    return out.withColumns({f: F.when(F.col("feature") == f, F.col("value")).otherwise(F.col(f)) for f in names}).drop("value")


def permutation_importance(rows: DataFrame, id_col: str, features: Sequence[str], score: Callable[[DataFrame], DataFrame], metric: Callable[[DataFrame, list[str]], DataFrame], repeats: int = 5, seed: int = 7) -> DataFrame:
    """(feature, mean, std): by how much a metric falls, over repeats, when a feature is permuted; negative ones stay.

    rows are the validation part with unique ids and labels; score adds ``p`` to rows; metric gives (keys, value) of scored rows by keys.
    """
    base = metric(score(rows).withColumn("all", F.lit(1)), ["all"]).select(F.col("value").alias("base"))
    after = metric(score(permuted(rows, id_col, features, repeats, seed)), ["feature", "repeat"])
    drop = after.crossJoin(F.broadcast(base)).withColumn("drop", F.col("base") - F.col("value"))
    return drop.groupBy("feature").agg(F.avg("drop").alias("mean"), F.stddev_pop("drop").alias("std"))


def tree_importance(model: PipelineModel, features: Sequence[str]) -> list[tuple[str, str, float | None]]:
    """(feature, status, importance) of the model's last stage; not_applicable without importances, as many rows as features."""
    last = model.stages[-1]
    if not hasattr(last, "featureImportances"):
        return [(f, "not_applicable", None) for f in features]
    return [(f, "available", float(v)) for f, v in zip(features, last.featureImportances.toArray(), strict=True)]

