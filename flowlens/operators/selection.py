"""Choosing models by versioned policies, and how they do on attack families that they have not seen."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.operators.metrics import best_of, confusion_metrics

#: the parts that rows fall into by time: what is fitted on, what is chosen on, what is judged on
STAGES = {"early": "train", "middle": "validation", "late": "evaluation"}
BENIGN = "benign"


def select_model(candidates: DataFrame) -> DataFrame:
    """candidates (candidate, macro_f1, pr_auc, recall, fpr, brier, cv_std) with place, best first; the larger name settles ties.

    Metrics that are missing count as worst. Accuracy, latency and size have no part.
    """
    return best_of(candidates, [F.desc("macro_f1"), F.desc_nulls_last("pr_auc"), F.desc("recall"), F.asc("fpr"), F.asc_nulls_last("brier"), F.asc_nulls_last("cv_std"), F.desc("candidate")])


#: what each policy ranks by, from the first; "-" for the smaller one. The others than 1.0.0 ask for a hit
ANOMALY_POLICIES = {
    "1.0.0": ("within_limit", "pr_auc", "f1", "recall", "balanced_accuracy", "-fpr", "-fpr_std"),
    "1.0.1": ("f1", "recall", "pr_auc", "balanced_accuracy", "-fpr", "-n_estimators", "-max_samples", "-max_features"),
    "2.0.0": ("f1", "recall", "pr_auc", "balanced_accuracy", "-fpr"),
}


def select_anomaly_model(candidates: DataFrame, policy: str) -> DataFrame:
    """candidates with place by a policy; the smaller candidate settles ties, a missing pr_auc counts as -1. Nothing is left where no candidate is eligible."""
    if policy not in ANOMALY_POLICIES:
        raise ValueError(f"no policy {policy}")
    known = candidates.withColumn("_pr", F.coalesce("pr_auc", F.lit(-1.0)))
    if policy != "1.0.0":
        known = known.where("f1 > 0 and recall > 0")
    name = lambda c: "_pr" if c == "pr_auc" else c
    order = [F.asc(c[1:]) if c.startswith("-") else F.desc(name(c)) for c in ANOMALY_POLICIES[policy]]
    return best_of(known, [*order, F.asc("candidate")]).drop("_pr")


def without_family(rows: DataFrame, family: str, stage: str = "stage", column: str = "family") -> DataFrame:
    """rows with part: early ones without the family train, middle ones without it validate, late ones of it and benign ones evaluate; the others are left out."""
    here = F.col(column)
    part = F.when((F.col(stage) == "late") & here.isin(BENIGN, family), "evaluation").when((F.col(stage) == "early") & (here != family), "train").when((F.col(stage) == "middle") & (here != family), "validation")
    return rows.withColumn("part", part).where("part is not null")


def isolation_violations(parts: DataFrame, family: str, keys: Sequence[str], column: str = "family") -> DataFrame:
    """(rule, n): values of a key (group, source, session, ...) that occur in more than one part, and rows of the family that are fitted or chosen on."""
    shared = [parts.groupBy(k).agg(F.count_distinct("part").alias("parts")).where("parts > 1").agg(F.count(F.lit(1)).alias("n")).select(F.lit(f"{k}_overlap").alias("rule"), "n") for k in keys]
    leaked = parts.where((F.col("part") != "evaluation") & (F.col(column) == family)).agg(F.count(F.lit(1)).alias("n")).select(F.lit("family_leaked").alias("rule"), "n")
    return reduce(DataFrame.unionByName, [*shared, leaked]).where("n > 0")


def leave_one_family_out(rows: DataFrame, families: Sequence[str], keys: Sequence[str], fit: Callable[[DataFrame, DataFrame], Callable[[DataFrame], DataFrame]], label: str = "label") -> DataFrame:
    """(family, n, recall, fpr, macro_f1) of models that have never seen the family, on its late rows and the late benign ones.

    fit takes training and validation rows and gives what adds ``hit`` to rows. Families are a stated few; each is a fit of its own,
    refused where a key's value or the family itself is in two parts.
    """
    out = []
    for family in families:
        parts = without_family(rows, family)
        broken = isolation_violations(parts, family, keys).collect()
        if broken:
            raise ValueError(f"{family} isn't isolated: {[tuple(r) for r in broken]}")
        of = lambda name, parts=parts: parts.where(F.col("part") == name)
        judged = fit(of("train"), of("validation"))(of("evaluation")).withColumn("held_out", F.lit(family))
        m = confusion_metrics(judged, ["held_out"], F.col(label), F.col("hit"))
        out.append(m.select(F.col("held_out").alias("family"), (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).alias("n"), "recall", "fpr", "macro_f1"))
    return reduce(DataFrame.unionByName, out)
