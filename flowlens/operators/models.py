"""Supervised models over labelled rows: group folds, tuning, calibration, scoring and detections."""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.functions.scalars import clamp01, interpolate, uuid5, weighted_score
from flowlens.operators.detect import map_risk, reason_codes, severity_band
from flowlens.operators.explain import local_contributions
from flowlens.operators.isolation import Forest, isolation_score
from flowlens.operators.metrics import best_of, brier, confusion_metrics, curve_areas
from flowlens.operators.ranks import exact_quantiles, value_counts
from flowlens.operators.tables import stored

#: candidates by name: estimator and its parameters
CANDIDATES = {
    "decision_tree": lambda: DecisionTreeClassifier(maxDepth=5, seed=7),
    "gradient_boosting": lambda: GBTClassifier(maxDepth=3, maxIter=10, seed=7),
    "logistic_regression": lambda: LogisticRegression(maxIter=50, regParam=0.01, featuresCol="scaled"),
    "random_forest": lambda: RandomForestClassifier(numTrees=20, maxDepth=5, seed=7),
}


def group_folds(rows: DataFrame, group: str, k: int) -> DataFrame:
    """(group, fold): whole groups, the largest first, each to the fold that has the fewest rows so far; ties go to the smaller group and fold.

    The rule takes one group after the other: groups, a row each, stream through one task that holds k sums.
    """
    sizes = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    kind = rows.schema[group].dataType.simpleString()

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folds = [(0, i) for i in range(k)]
        for batch in batches:
            out = []
            for n in batch.column("n").to_pylist():
                held, fold = heapq.heappop(folds)
                heapq.heappush(folds, (held + n, fold))
                out.append(fold)
            yield pa.RecordBatch.from_arrays([batch.column(group), pa.array(out, pa.int64())], [group, "fold"])

    return sizes.repartition(1).sortWithinPartitions(F.desc("n"), group).mapInArrow(dealt, f"`{group}` {kind}, fold long")


def fold_violations(rows: DataFrame, folds: DataFrame, group: str, label: str, keys: Sequence[str] = ()) -> DataFrame:
    """(rule, value) for which folds are refused: a fold, or what is left without it, of one class; a key (source, session, scenario, ...) in several folds; fewer than two groups."""
    dealt = rows.join(folds, group)
    per = dealt.groupBy("fold").agg(F.count_if(F.col(label) == 1).alias("y"), F.count_if(F.col(label) == 0).alias("z"))
    whole = per.agg(F.sum("y").alias("all_y"), F.sum("z").alias("all_z"))
    single = per.crossJoin(F.broadcast(whole)).where("least(y, z, all_y - y, all_z - z) = 0").select(F.lit("single_class").alias("rule"), F.col("fold").cast("string").alias("value"))
    shared = [dealt.groupBy(F.col(c).cast("string").alias("value")).agg(F.count_distinct("fold").alias("folds")).where("folds > 1").select(F.lit(f"{c}_overlap").alias("rule"), "value") for c in keys]
    few = folds.agg(F.count(F.lit(1)).alias("n")).where("n < 2").select(F.lit("too_few_groups").alias("rule"), F.col("n").cast("string").alias("value"))
    return reduce(DataFrame.unionByName, [single, *shared, few])


def fitted(rows: DataFrame, features: Sequence[str], name: str) -> PipelineModel:
    """A candidate fitted on rows with a column label; features keep their order."""
    stages = [VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="error"), StandardScaler(inputCol="features", outputCol="scaled", withMean=True), CANDIDATES[name]()]
    return Pipeline(stages=stages).fit(rows.withColumn("label", F.col("label").cast("double")))


def with_probability(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """rows with p, the probability of an attack."""
    hidden = ("features", "scaled", "rawPrediction", "probability", "prediction")
    return model.transform(rows).withColumn("p", vector_to_array("probability")[1]).drop(*hidden)


def tune(rows: DataFrame, features: Sequence[str], folds: DataFrame, group: str, names: Sequence[str] = tuple(CANDIDATES)) -> DataFrame:
    """(candidate, macro_f1, pr_auc, recall, fpr, place): held-out metrics at 0.5, averaged over folds, best first.

    The grid and the folds are a fixed few; each fit is a distributed job of its own.
    """
    broken = fold_violations(rows, folds, group, "label").limit(5).collect()
    if broken:
        raise ValueError(f"folds are refused: {[tuple(r) for r in broken]}")
    # each fit passes over them many times
    dealt = stored(rows.join(folds, group).select(*features, "label", "fold"), "folds")
    k = [r["fold"] for r in folds.select("fold").distinct().orderBy("fold").collect()]
    scored = [with_probability(fitted(dealt.where(F.col("fold") != i), features, n), dealt.where(F.col("fold") == i)).select(F.lit(n).alias("candidate"), "fold", "label", "p") for n in names for i in k]
    held = reduce(DataFrame.unionByName, scored)
    by = ["candidate", "fold"]
    m = confusion_metrics(held, by, F.col("label"), F.col("p") >= 0.5).join(curve_areas(held, by, "p"), by)
    mean = m.groupBy("candidate").agg(*[F.round(F.avg(c), 9).alias(c) for c in ("macro_f1", "pr_auc", "recall", "fpr")])
    return best_of(mean, [F.desc("macro_f1"), F.desc("pr_auc"), F.desc("recall"), F.col("fpr"), F.col("candidate")])


def calibrate(rows: DataFrame, least: int = 3) -> tuple[DataFrame, Column]:
    """((method, brier, place), calibrated p as a column of p): sigmoid or isotonic on validation rows (p, label); the lower Brier score wins, ties by name.

    With fewer than ``least`` rows of a class p stays as it is.
    """
    counts = rows.groupBy("label").count().collect()
    rows = rows.select("p", F.col("label").cast("double").alias("label"))
    if len(counts) < 2 or min(r["count"] for r in counts) < least:
        return brier(rows.withColumn("method", F.lit("none")), ["method"], "p").withColumn("place", F.lit(1)), F.col("p")
    line = LogisticRegression(featuresCol="x", maxIter=50).fit(VectorAssembler(inputCols=["p"], outputCol="x").transform(rows))
    sigmoid = 1 / (1 + F.exp(-(F.col("p") * float(line.coefficients[0]) + float(line.intercept))))
    steps = IsotonicRegression(featuresCol="p").fit(rows)
    # at most as many knots as the fit has steps
    x, y = [float(v) for v in steps.boundaries], [float(v) for v in steps.predictions]
    xs, ys = F.lit(x), F.lit(y)
    at = F.aggregate(xs, F.lit(0), lambda a, v: a + (v <= F.col("p")).cast("int"))
    lo, hi = F.get(xs, at - 1), F.get(xs, at)
    between = F.get(ys, at - 1) + (F.get(ys, at) - F.get(ys, at - 1)) * (F.col("p") - lo) / F.when(hi > lo, hi - lo)
    isotonic = F.when(at == 0, y[0]).when(at == len(x), y[-1]).otherwise(between)
    methods = {"isotonic": isotonic, "sigmoid": sigmoid}
    tried = reduce(DataFrame.unionByName, [rows.select(F.lit(n).alias("method"), c.alias("q"), "label") for n, c in methods.items()])
    ranked = best_of(brier(tried, ["method"], "q"), [F.round("brier", 12), F.col("method")])
    return ranked, methods[ranked.where("place = 1").first()["method"]]


def benign_ranks(scored: DataFrame, column: str, steps: int = 20) -> list[tuple[float, float]]:
    """(score, share) knots of the benign scores' distribution; a rising score rises in share."""
    quantiles = {f"q{i}": i / steps for i in range(steps + 1)}
    row = exact_quantiles(value_counts(scored.where(F.col(column).isNotNull()), [], column), [], quantiles).first()
    knots: dict[float, float] = {}
    if row is not None and row["n"]:
        for i in range(steps + 1):
            knots[row[f"q{i}"]] = i / steps
    return sorted(knots.items())


def score_flows(rows: DataFrame, model: PipelineModel, calibrated: Column, anomaly: Column, weight: float = 0.75, ranks: Sequence[tuple[float, float]] = ()) -> DataFrame:
    """rows with supervised, anomaly and fusion scores, each in [0, 1]; with ranks, the anomaly score becomes the share of benign rows that score lower."""
    out = with_probability(model, rows).withColumn("_raw", anomaly)
    normal = interpolate(F.col("_raw"), list(ranks)) if ranks else F.col("_raw")
    return out.withColumns({"supervised": clamp01(calibrated), "anomaly": F.when(F.col("_raw").isNotNull(), normal)}).drop("_raw").withColumn("fusion", weighted_score(F.col("supervised"), F.col("anomaly"), weight, 1 - weight))


#: the namespace of detection ids: version-5 UUIDs of their content
DETECTIONS = uuid.uuid5(uuid.NAMESPACE_URL, "flowlens:detections")


def detection_id(id_col: str, policy: str) -> Column:
    """The same flow, scores and policy have the same id, so that a replay finds what it has stored."""
    content = F.concat_ws("|", F.col(id_col).cast("string"), *[F.format_string("%.12f", c) for c in ("supervised", "anomaly", "fusion")], F.lit(policy))
    return uuid5(DETECTIONS, content)


def detect(scored: DataFrame, threshold: float = 0.7) -> DataFrame:
    """One detection for each row: its risk, severity and whether it calls for an alert."""
    return map_risk(scored, "fusion", threshold).withColumn("severity", severity_band(F.col("risk")))


def detections(flows: DataFrame, id_col: str, features: Sequence[str], score: Callable[[DataFrame], DataFrame], profile: DataFrame, thresholds: tuple[float, float, float] = (0.5, 0.9, 0.7), policy: str = "1.0.0", k: int = 5) -> DataFrame:
    """One detection a flow: detection_id, scores, risk, severity, alert_required, codes, and the k features that count most.

    score adds supervised, anomaly and fusion to rows of features; thresholds are those of supervised score, anomaly score and risk.
    """
    supervised_at, anomaly_at, risk_at = thresholds
    risk = lambda df: score(df).withColumn("risk", F.col("fusion"))
    found = reason_codes(detect(score(flows), risk_at), profile, supervised_at, anomaly_at, risk_at)
    found = found.withColumn("detection_id", detection_id(id_col, policy)).select("detection_id", id_col, "supervised", "anomaly", "fusion", "risk", "severity", "alert_required", "codes")
    return found.join(local_contributions(flows, id_col, features, profile, risk, k), id_col)
