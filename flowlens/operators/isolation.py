"""Isolation forest: trees of random cuts over hash samples of benign rows; rows that few cuts set apart are anomalous."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import ceil, log2

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EULER = 0.5772156649015329


def usual_path(n: int) -> float:
    """Mean length of an unsuccessful search in a binary search tree of n keys: how deep n rows would go on average."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2.0 * (np.log(n - 1.0) + EULER) - 2.0 * (n - 1.0) / n


def grown(x: np.ndarray, rng: np.random.Generator, most: int) -> tuple[list[int], list[float], list[int], list[float]]:
    """(column, cut, first child, path length) of each node: a random column that varies is cut evenly at random until rows stand alone, are alike or are deep enough.

    The second child follows the first. Inner nodes have no path length, leaves no column (-1).
    """
    column, cut, child, path = [-1], [0.0], [-1], [0.0]
    todo = [(0, x, 0)]
    while todo:
        node, rows, depth = todo.pop()
        low, high = rows.min(0), rows.max(0)
        varies = np.flatnonzero(low < high)
        if depth >= most or len(rows) < 2 or not len(varies):
            path[node] = depth + usual_path(len(rows))
            continue
        c = int(rng.choice(varies))
        at = float(rng.uniform(low[c], high[c]))
        # a cut at the low end would leave one side empty
        left = rows[:, c] < at if at > low[c] else rows[:, c] <= at
        column[node], cut[node], child[node], path[node] = c, at if at > low[c] else float(np.nextafter(at, np.inf)), len(column), np.nan
        for side in (left, ~left):
            todo.append((len(column), rows[side], depth + 1))
            column.append(-1)
            cut.append(0.0)
            child.append(-1)
            path.append(0.0)
    return column, cut, child, path


@dataclass(frozen=True)
class Forest:
    """The trees as arrays, of at most twice ``sample`` nodes each, and the features in their order."""

    features: tuple[str, ...]
    trees: tuple[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray], ...]
    sample: int

    def scores(self, x: np.ndarray) -> np.ndarray:
        """2 ** -(mean path / usual path) in (0, 1], higher for more anomalous rows; NaN for rows that aren't finite."""
        total = np.zeros(len(x))
        known = np.isfinite(x).all(1)
        rows = np.flatnonzero(known)
        for column, cut, child, path in self.trees:
            at = np.zeros(len(rows), np.int64)
            live = np.flatnonzero(column[at] >= 0)
            while len(live):
                node = at[live]
                at[live] = child[node] + (x[rows[live], column[node]] >= cut[node])
                live = live[column[at[live]] >= 0]
            total[rows] += path[at]
        usual = usual_path(self.sample)
        out = np.full(len(x), np.nan)
        out[rows] = 2.0 ** -(total[rows] / len(self.trees) / usual) if usual else 0.5
        return out


def sampled(benign: DataFrame, id_col: str, trees: int, sample: int, seed: int) -> DataFrame:
    """benign with tree: for each tree the rows of the smallest hashes, ``sample`` of them or all; rows of no tree are gone before the shuffle."""
    n = benign.count()
    hashed = lambda t: F.pmod(F.xxhash64(F.lit(seed), t, F.col(id_col)), F.lit(1 << 31))
    # twice as many as are wanted come below the limit on average
    limit = (1 << 31) if n <= 2 * sample + 64 else int((2 * sample + 64) / n * (1 << 31))
    each = benign.withColumn("tree", F.explode(F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: hashed(t) < limit)))
    place = F.row_number().over(Window.partitionBy("tree").orderBy(hashed(F.col("tree")), id_col))
    return each.withColumn("_place", place).where(F.col("_place") <= sample).drop("_place")


def fit_forest(benign: DataFrame, id_col: str, features: Sequence[str], trees: int = 64, sample: int = 256, share: float = 1.0, seed: int = 7) -> Forest:
    """A forest of rows that are benign; ``share`` of the features, at random, are open to a tree.

    Cuts are even between a column's ends, so that standardised columns would be cut alike. Rows with null or non-finite features don't
    take part; without rows every score is 0.5. Sample and forest depend on ids and seed only, not on partitions.
    """
    if trees < 1 or sample < 2 or not 0 < share <= 1:
        raise ValueError("a forest has trees of at least two rows and a share of the features")
    columns = list(features)
    good = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    rows = benign.select(F.col(id_col).cast("string").alias("_id"), *[F.col(c).cast("double").alias(c) for c in columns])
    for c in columns:
        rows = rows.where(good(c))
    most = ceil(log2(sample))

    def grow(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        rng = np.random.default_rng([seed, int(key[0])])
        open_ = np.sort(rng.permutation(len(columns))[: max(1, round(share * len(columns)))])
        column, cut, child, path = grown(frame.sort_values(["_id", *columns])[[columns[i] for i in open_]].to_numpy(float), rng, most)
        return pd.DataFrame({"tree": [int(key[0])], "column": [[int(open_[c]) if c >= 0 else -1 for c in column]], "cut": [cut], "child": [child], "path": [path], "rows": [len(frame)]})

    made = sampled(rows, "_id", trees, sample, seed).groupBy("tree").applyInPandas(grow, "tree int, column array<int>, cut array<double>, child array<int>, path array<double>, rows int")
    # at most ``trees`` rows of arrays of twice ``sample`` nodes
    found = sorted(made.collect(), key=lambda r: r["tree"])
    nodes = tuple((np.array(r["column"]), np.array(r["cut"]), np.array(r["child"]), np.array(r["path"], float)) for r in found)
    leaf = (np.array([-1]), np.zeros(1), np.array([-1]), np.array([usual_path(sample)]))
    return Forest(tuple(columns), nodes or (leaf,), max((r["rows"] for r in found), default=sample))


def isolation_score(forest: Forest) -> Column:
    """The score as a column of the features, all trees in one Arrow pass; null where a feature is null or not finite."""

    @F.pandas_udf("double")
    def score(*values: pd.Series) -> pd.Series:
        return pd.Series(forest.scores(np.stack([v.to_numpy(float) for v in values], 1)))

    s = score(*[F.col(c).cast("double") for c in forest.features])
    return F.when(~F.isnan(s), s)
