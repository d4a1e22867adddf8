"""Metrics of scores and labels, threshold grids and the selection of candidates."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowlens.functions.scalars import safe_ratio
from flowlens.operators.ranks import exact_quantiles, value_counts
from flowlens.operators.tables import stored


def confusion_metrics(rows: DataFrame, by: Sequence[str], label: Column, predicted: Column) -> DataFrame:
    """Counts and rates by key from one aggregation; a rate without a denominator is 0."""
    y, p = label == 1, predicted
    out = rows.groupBy(*by).agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"))
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    precision, recall, specificity = safe_ratio(tp, tp + fp), safe_ratio(tp, tp + fn), safe_ratio(tn, tn + fp)
    f1, f0 = safe_ratio(2 * tp, 2 * tp + fp + fn), safe_ratio(2 * tn, 2 * tn + fp + fn)
    values = {
        "accuracy": safe_ratio(tp + tn, tp + fp + fn + tn), "precision": precision, "recall": recall, "specificity": specificity, "fpr": safe_ratio(fp, fp + tn), "fnr": safe_ratio(fn, fn + tp), "f1": f1, "macro_f1": (f1 + f0) / 2,
        "weighted_f1": safe_ratio(f1 * (tp + fn) + f0 * (tn + fp), tp + fp + fn + tn), "balanced_accuracy": (recall + specificity) / 2,
        "mcc": safe_ratio(tp * tn - fp * fn, F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn)),
    }
    return out.withColumns(values)


def curve_areas(rows: DataFrame, by: Sequence[str], score: str, label: str = "label") -> DataFrame:
    """roc_auc (ties averaged) and pr_auc (average precision stepped at distinct scores) by key; null with one class.

    Equal scores are collapsed first, so that windows run over distinct scores.
    """
    c = rows.groupBy(*by, F.col(score).alias("s")).agg(F.sum(label).cast("double").alias("pos"), F.sum(1 - F.col(label)).cast("double").alias("neg"))
    down = Window.partitionBy(*by).orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*by)
    c = c.withColumns({"tp": F.sum("pos").over(down), "fp": F.sum("neg").over(down), "p": F.sum("pos").over(whole), "n": F.sum("neg").over(whole)})
    # pairs in which the negative scores lower, ties half
    wins = F.col("pos") * (F.col("n") - F.col("fp") + F.col("neg") / 2)
    out = c.groupBy(*by).agg(F.sum(wins).alias("wins"), F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("ap"), F.max("p").alias("p"), F.max("n").alias("n"))
    both = (F.col("p") > 0) & (F.col("n") > 0)
    return out.select(*by, F.when(both, F.col("wins") / (F.col("p") * F.col("n"))).alias("roc_auc"), F.when(both, F.col("ap") / F.col("p")).alias("pr_auc"))


def brier(rows: DataFrame, by: Sequence[str], score: str, label: str = "label") -> DataFrame:
    return rows.groupBy(*by).agg(F.avg(F.pow(F.col(score) - F.col(label), F.lit(2))).alias("brier"))


def group_stability(rows: DataFrame, group: str, predicted: Column, label: str = "label") -> DataFrame:
    """Mean and deviation over groups of the benign false-positive rate and the attack recall, and groups that lack a class."""
    y = F.col(label) == 1
    per = rows.groupBy(group).agg(F.avg(F.when(~y, predicted.cast("double"))).alias("fpr"), F.avg(F.when(y, predicted.cast("double"))).alias("recall"))
    return per.agg(F.avg("fpr").alias("fpr_mean"), F.stddev_pop("fpr").alias("fpr_std"), F.avg("recall").alias("recall_mean"), F.stddev_pop("recall").alias("recall_std"), F.count_if(F.col("fpr").isNull()).alias("without_benign"), F.count_if(F.col("recall").isNull()).alias("without_attack"))


def score_distribution(rows: DataFrame, by: Sequence[str], score: str) -> DataFrame:
    counts = value_counts(rows, by, score)
    ends = rows.groupBy(*by).agg(F.min(score).alias("lo"), F.max(score).alias("hi"), F.avg(score).alias("mean"), F.stddev_pop(score).alias("std"))
    quantiles = exact_quantiles(counts, by, {"q05": 0.05, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q95": 0.95})
    names = ("n", "lo", "q05", "q25", "q50", "q75", "q95", "hi", "mean", "std")
    return (quantiles.join(ends, list(by)) if by else quantiles.crossJoin(ends)).select(*by, *names)


def threshold_curve(rows: DataFrame, score: str, thresholds: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Confusion metrics at each threshold; the grid is a literal of fixed size, and partial aggregation keeps the shuffle to its rows."""
    grid = rows.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    return confusion_metrics(grid, [*by, "threshold"], F.col("label"), F.col(score) >= F.col("threshold"))


def best_of(candidates: DataFrame, order: Sequence[Column], by: Sequence[str] = ()) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order) if by else Window.orderBy(*order)
    return candidates.withColumn("place", F.row_number().over(w).cast("long"))


def select_threshold(rows: DataFrame, score: str, thresholds: Sequence[float]) -> DataFrame:
    """Best macro-F1, then recall, lower false-positive rate, closeness to .5, lower threshold."""
    r = lambda c: F.round(c, 9)
    ranked = best_of(threshold_curve(rows, score, thresholds), [F.desc(r("macro_f1")), F.desc(r("recall")), r("fpr"), r(F.abs(F.col("threshold") - 0.5)), F.col("threshold")])
    return ranked.where("place = 1").drop("place")


def anomaly_thresholds(rows: DataFrame, score: str, thresholds: Sequence[float], most_fpr: float) -> DataFrame:
    """Thresholds within the false-positive limit, best first by F1, recall, balanced accuracy, lower rate, lower threshold."""
    r = lambda c: F.round(c, 9)
    ok = threshold_curve(rows, score, thresholds).where(F.col("fpr") <= most_fpr)
    return best_of(ok, [F.desc(r("f1")), F.desc(r("recall")), F.desc(r("balanced_accuracy")), r("fpr"), F.col("threshold")])


def select_fusion(rows: DataFrame, weights: Sequence[float], thresholds: Sequence[float], most_fpr: float = 0.25) -> DataFrame:
    """Each supervised weight and threshold under the limit with a hit, ranked by macro-F1, recall, lower rate, weight, threshold."""
    grid = rows.withColumn("weight", F.explode(F.array(*[F.lit(float(w)) for w in weights])))
    grid = grid.withColumn("fused", F.round(F.col("p") * F.col("weight") + F.col("a") * (1 - F.col("weight")), 9))
    m = threshold_curve(grid, "fused", thresholds, ["weight"]).where((F.col("fpr") <= most_fpr) & (F.col("recall") > 0) & (F.col("f1") > 0))
    r = lambda c: F.round(c, 9)
    return best_of(m, [F.desc(r("macro_f1")), F.desc(r("recall")), r("fpr"), F.col("weight"), F.col("threshold")])


def metric_deltas(metrics: DataFrame, base: str, other: str, names: Sequence[str]) -> DataFrame:
    """(metric, delta) of two modes of (mode, metrics...)."""
    long = metrics.unpivot(["mode"], list(names), "metric", "value")
    a, b = (long.where(F.col("mode") == m).select("metric", F.col("value").alias(m)) for m in (base, other))
    return a.join(b, "metric", "full").select("metric", (F.col(other) - F.col(base)).alias("delta"))


def histogram(rows: DataFrame, column: str, bins: int) -> DataFrame:
    """(bin, n) over equal widths of [min, max], zero-filled; a constant column is padded on either side."""
    ends = rows.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    pad = F.greatest(F.abs(F.col("lo")) * 0.05, F.lit(0.5))
    flat = F.col("lo") == F.col("hi")
    ends = ends.select(F.when(flat, F.col("lo") - pad).otherwise(F.col("lo")).alias("lo"), F.when(flat, F.col("hi") + pad).otherwise(F.col("hi")).alias("hi"))
    at = F.least(F.floor((F.col(column) - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))
    counts = rows.where(F.col(column).isNotNull()).crossJoin(F.broadcast(ends)).groupBy(at.cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return rows.sparkSession.range(bins).withColumnRenamed("id", "bin").join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def empirical_cdf(reference: DataFrame, score: str) -> DataFrame:
    """(score, rank): mid-rank probabilities of the distinct reference scores."""
    c = reference.groupBy(F.col(score).alias("score")).agg(F.count(F.lit(1)).alias("c"))
    w = Window.orderBy("score").rowsBetween(Window.unboundedPreceding, 0)
    n = F.sum("c").over(Window.orderBy("score").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return c.select("score", ((F.sum("c").over(w) - F.col("c") / 2) / n).alias("rank"))


#: axis of a shift: columns that are multiplied, columns that are divided
SHIFTS = {"duration": (("quantity",), ("price",)), "size": (("price", "discount"), ())}


def parameter_shift(rows: DataFrame, axis: str, factor: float, whole: Sequence[str] = ()) -> DataFrame:
    """rows with an axis' columns scaled; columns in ``whole`` are rounded half to even; groups get identities of their own."""
    up, down = SHIFTS[axis]
    scaled = {c: F.col(c) * factor for c in up} | {c: F.col(c) / factor for c in down}
    scaled = {c: F.bround(v) if c in whole else v for c, v in scaled.items()}
    return rows.withColumns(scaled).withColumn("group_id", F.concat(F.lit(f"{axis}-"), F.col("group_id").cast("string")))


#: metrics that a draw may lack, as it has no attack, no benign row, or neither prediction
BOOTSTRAPPED = ("recall", "f1", "macro_f1", "pr_auc", "fpr", "precision", "specificity", "fnr", "accuracy", "balanced_accuracy", "mcc", "roc_auc", "weighted_f1")


#: groups whose draws one task weights, scores for which it does so, and scores of one product
DRAWN_GROUPS, DRAWN_SCORES, DRAWN_CELLS = 2048, 4096, 1024


def numbered_groups(rows: DataFrame, group: str) -> DataFrame:
    """(group, k): the groups' places from 0."""
    return rows.select(group).distinct().select(group, (F.row_number().over(Window.orderBy(group)) - 1).cast("long").alias("k"))


def drawn_groups(spark: SparkSession, n: int, draws: int, seed: int) -> DataFrame:
    """(draw, k): n of n groups drawn with replacement in each draw, by digests of seed, draw and slot; a row for each slot."""
    slots = spark.range(draws * n).select((F.col("id") / n).cast("long").alias("draw"), (F.col("id") % n).alias("slot"))
    digest = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col("draw").cast("string"), F.col("slot").cast("string")), 256)
    return slots.select(F.col("draw").cast("int").alias("draw"), (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") % n).alias("k"))


def draw_metrics(rows: DataFrame, group: str, scores: dict[str, float], groups: DataFrame, picks: DataFrame, draws: int, label: str = "label") -> DataFrame:
    """(draw, mode, a column for each of BOOTSTRAPPED) for each score column and its threshold, all on the same picks (draw, k) of groups (group, k); null where a draw lacks what a metric needs.

    Rows are first reduced to (mode, group, score) with positives and negatives; a draw weights a group's cells by how often
    it is in it. Cells and picks meet in blocks of groups: the times of a block's groups by draws, multiplied with the groups' cells by
    scores, are one row for each draw and score, whatever the number of groups. A block with many scores is dealt to several tasks.
    """
    y = F.col(label) == 1
    long = rows.select(group, y.alias("y"), F.explode(F.array(*[F.struct(F.lit(i).alias("m"), F.col(c).cast("double").alias("s")) for i, c in enumerate(scores)])).alias("x")).select(group, "y", "x.*")
    cells = long.groupBy("m", group, "s").agg(F.count_if("y").alias("pos"), F.count_if(~F.col("y")).alias("neg"))
    block = F.floor(F.col("k") / DRAWN_GROUPS).alias("block")
    cells = stored(cells.join(groups, group).select(block, (F.col("k") % DRAWN_GROUPS).cast("int").alias("k"), "m", "s", F.col("s").isNull().alias("none"), "pos", "neg"), "cells")
    # a row for each block
    sizes = cells.groupBy("block").agg(F.ceil(F.count_distinct(F.struct("m", "s")) / DRAWN_SCORES).alias("pieces"))
    cells = cells.join(sizes, "block").withColumn("piece", F.pmod(F.xxhash64("m", "s"), F.col("pieces"))).drop("pieces")
    dealt = picks.select(block, (F.col("k") % DRAWN_GROUPS).cast("int").alias("k"), "draw").join(sizes, "block")
    dealt = dealt.select("block", "k", "draw", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)).alias("piece"))

    def weighted(c: pa.Table, p: pa.Table) -> pa.Table:
        empty = np.zeros(0, np.int64)
        out = [(empty, empty, np.zeros(0), np.zeros(0, bool), empty, empty)]
        if c.num_rows and p.num_rows:
            times = np.bincount(p["draw"].to_numpy() * np.int64(DRAWN_GROUPS) + p["k"].to_numpy(), minlength=draws * DRAWN_GROUPS).reshape(draws, DRAWN_GROUPS)
            used = np.flatnonzero(times.any(0))
            times = times[:, used].astype(float)
            c = c.filter(pa.array(np.isin(c["k"].to_numpy(), used))).sort_by([("m", "ascending"), ("none", "ascending"), ("s", "ascending")])
            k, m, s, none, pos, neg = (c[x].to_numpy() for x in ("k", "m", "s", "none", "pos", "neg"))
            k = np.searchsorted(used, k)
            same = (m[1:] == m[:-1]) & (none[1:] == none[:-1]) & ((s[1:] == s[:-1]) | (np.isnan(s[1:]) & np.isnan(s[:-1])))
            starts = np.flatnonzero(np.r_[True, ~same][: len(k)])
            which = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(k)]))
            for first in range(0, len(starts), DRAWN_CELLS):
                some = np.flatnonzero((which >= first) & (which < first + DRAWN_CELLS))
                of, at = k[some], which[some] - first
                head = starts[first : first + DRAWN_CELLS]
                sums = []
                # whole numbers below 2 ** 53: the products are exact
                for v in (pos, neg):
                    table = np.zeros((len(used), len(head)))
                    table[of, at] = v[some]
                    sums.append(np.rint(times @ table).astype(np.int64))
                draw, col = np.nonzero((sums[0] + sums[1]) > 0)
                out.append((draw, m[head[col]], s[head[col]], none[head[col]], sums[0][draw, col], sums[1][draw, col]))
        draw, m, s, none, pos, neg = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.table({"draw": pa.array(draw, pa.int32()), "m": pa.array(m, pa.int32()), "s": pa.array(s, pa.float64(), mask=none), "pos": pos, "neg": neg})

    found = cells.groupBy("block", "piece").cogroup(dealt.groupBy("block", "piece")).applyInArrow(weighted, "draw int, m int, s double, pos long, neg long")
    mode, at = (F.element_at(F.array(*[F.lit(x) for x in xs]), F.col("m") + 1) for xs in (list(scores), [float(t) for t in scores.values()]))
    by = ["draw", "mode"]
    c = found.groupBy("draw", "m", "s").agg(F.sum("pos").cast("double").alias("pos"), F.sum("neg").cast("double").alias("neg")).select(F.col("draw").cast("long").alias("draw"), mode.alias("mode"), "s", at.alias("at"), "pos", "neg")
    down = Window.partitionBy(*by).orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, 0)
    c = c.withColumns({"up": F.sum("pos").over(down), "down": F.sum("neg").over(down), "hit": F.col("s") >= F.col("at")})
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    c = c.groupBy(*by).agg(
        zero(F.sum(F.when(F.col("hit"), F.col("pos")))).alias("tp"), zero(F.sum(F.when(F.col("hit"), F.col("neg")))).alias("fp"), F.sum("pos").alias("p"), F.sum("neg").alias("n"),
        F.sum(F.col("pos") * F.col("up") / (F.col("up") + F.col("down"))).alias("ap"), F.sum(F.col("neg") * (F.col("up") - F.col("pos") / 2)).alias("wins"),
    )
    tp, fp, p, n = (F.col(x) for x in ("tp", "fp", "p", "n"))
    fn, tn = p - tp, n - fp
    some, both = (lambda x: x > 0), (p > 0) & (n > 0)
    f1, f0 = safe_ratio(2 * tp, 2 * tp + fp + fn), safe_ratio(2 * tn, 2 * tn + fp + fn)
    values = {
        "recall": F.when(some(p), tp / p), "f1": F.when(some(p), f1), "macro_f1": F.when(both, (f1 + f0) / 2), "pr_auc": F.when(both, F.col("ap") / p), "fpr": F.when(some(n), fp / n), "precision": safe_ratio(tp, tp + fp),
        "specificity": F.when(some(n), tn / n), "fnr": F.when(some(p), fn / p), "accuracy": (tp + tn) / (p + n), "balanced_accuracy": F.when(both, (tp / p + tn / n) / 2),
        "mcc": safe_ratio(tp * tn - fp * fn, F.sqrt(tp + fp) * F.sqrt(p) * F.sqrt(n) * F.sqrt(tn + fn)), "roc_auc": F.when(both, F.col("wins") / (p * n)), "weighted_f1": (f1 * p + f0 * n) / (p + n),
    }
    return c.select(*by, *[v.alias(k) for k, v in values.items()])


def group_bootstrap(rows: DataFrame, group: str, scores: dict[str, float], draws: int, seed: int, label: str = "label", metrics: Sequence[str] = BOOTSTRAPPED, base: str | None = None) -> DataFrame:
    """(mode, metric, lo, hi, draws, failed): 2.5 and 97.5 percentiles over resamples of whole groups; with base, also of mode - base on the same draws.

    failed counts draws that lack the metric; where all do, the interval is null.
    """
    if draws < 1000:
        raise ValueError("intervals need at least 1,000 draws")
    names = list(metrics)
    groups = stored(numbered_groups(rows, group), "groups")
    picks = drawn_groups(rows.sparkSession, groups.count(), draws, seed)
    found = draw_metrics(rows, group, scores, groups, picks, draws, label).select("draw", "mode", *names)
    if base is not None:
        # read twice
        found = stored(found, "draws")
    if base is not None:
        other = found.where(F.col("mode") == base).select("draw", *[F.col(m).alias(f"_{m}") for m in names])
        deltas = found.where(F.col("mode") != base).join(other, "draw").select("draw", F.concat("mode", F.lit(f"-{base}")).alias("mode"), *[(F.col(m) - F.col(f"_{m}")).alias(m) for m in names])
        found = found.unionByName(deltas)
    long = found.unpivot(["draw", "mode"], names, "metric", "value")
    # a value for each draw
    return long.groupBy("mode", "metric").agg(F.percentile("value", F.lit(0.025)).alias("lo"), F.percentile("value", F.lit(0.975)).alias("hi"), F.count("value").alias("draws"), F.count_if(F.col("value").isNull()).alias("failed"))


def evaluate_modes(rows: DataFrame, group: str, scores: dict[str, float], draws: int, seed: int, base: str, label: str = "label") -> DataFrame:
    """(mode, metric, value, lo, hi, failed) of modes on the same rows, and of their differences to base, each with its interval over the same resamples of groups."""
    groups = stored(numbered_groups(rows, group), "groups")
    point = draw_metrics(rows, group, scores, groups, groups.select(F.lit(0).alias("draw"), "k"), 1, label).unpivot(["mode"], list(BOOTSTRAPPED), "metric", "value")
    other = point.where(F.col("mode") == base).select("metric", F.col("value").alias("_base"))
    deltas = point.where(F.col("mode") != base).join(other, "metric").select(F.concat("mode", F.lit(f"-{base}")).alias("mode"), "metric", (F.col("value") - F.col("_base")).alias("value"))
    intervals = group_bootstrap(rows, group, scores, draws, seed, label, base=base)
    return point.unionByName(deltas).join(intervals, ["mode", "metric"]).select("mode", "metric", "value", "lo", "hi", "failed")
