"""Queries of model selection and of families that are held out."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens import adapters as A
from flowlens.operators import metrics as E
from flowlens.operators import models as M
from flowlens.operators import selection as S

QUERIES, ORACLES = {}, {}


def query(sql):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


#: candidates by name: the weight of the supervised score
WEIGHTS = {"anomaly": 0.0, "even": 0.5, "mostly": 0.75, "supervised": 1.0, "twin": 1.0}
_F1 = "(case when 2 * tp + fp + fn = 0 then 0 else 2 * tp / (2 * tp + fp + fn) end + case when 2 * tn + fp + fn = 0 then 0 else 2 * tn / (2 * tn + fp + fn) end) / 2"
_COUNT = "count(*) filter (s >= 0.5 and label = 1) as tp, count(*) filter (s >= 0.5 and label = 0) as fp, count(*) filter (s < 0.5 and label = 1) as fn, count(*) filter (s < 0.5 and label = 0) as tn"
CANDIDATES = A.cte("scores") + f""", w(candidate, weight) as (values {", ".join(f"('{n}', {w}::double)" for n, w in WEIGHTS.items())}), lg as (select candidate, group_id % 3 as fold, label, round(p * weight + a * (1 - weight), 9) as s from scores, w),
 c as (select candidate, {_COUNT}, avg((s - label) * (s - label)) as brier from lg group by 1), fo as (select candidate, fold, {_COUNT} from lg group by 1, 2), cv as (select candidate, stddev_pop({_F1}) as cv_std, stddev_pop(case when fp + tn = 0 then 0 else fp / (fp + tn) end) as fpr_std from fo group by 1),
 ds as (select candidate, s, sum(label) as pos, count(*) as n from lg group by 1, 2), up as (select *, sum(pos) over w as tpos, sum(n) over w as tn_ from ds window w as (partition by candidate order by s desc rows unbounded preceding)),
 ap as (select candidate, sum(pos * tpos / tn_) / sum(pos) as pr_auc from up group by 1),
 me as (select candidate, round({_F1}, 9) as macro_f1, round(pr_auc, 9) as pr_auc, round(case when tp + fn = 0 then 0 else tp / (tp + fn) end, 9) as recall, round(case when fp + tn = 0 then 0 else fp / (fp + tn) end, 9) as fpr, round(brier, 9) as brier, round(cv_std, 9) as cv_std,
  round(fpr_std, 9) as fpr_std, round(case when 2 * tp + fp + fn = 0 then 0 else 2 * tp / (2 * tp + fp + fn) end, 9) as f1, round((case when tp + fn = 0 then 0 else tp / (tp + fn) end + case when fp + tn = 0 then 0 else tn / (fp + tn) end) / 2, 9) as balanced_accuracy from c join cv using (candidate) join ap using (candidate))"""


def candidates(s, d):
    """Each candidate's metrics at 0.5, with the deviation over three folds of groups."""
    rows = A.scores_lines(s, d).withColumn("fold", F.col("group_id") % 3)
    grid = F.explode(F.array(*[F.struct(F.lit(n).alias("candidate"), F.lit(w).alias("weight")) for n, w in WEIGHTS.items()])).alias("w")
    rows = rows.select("*", grid).select("w.candidate", "fold", "label", F.round(F.col("p") * F.col("w.weight") + F.col("a") * (1 - F.col("w.weight")), 9).alias("s"))
    hit = F.col("s") >= 0.5
    folds = E.confusion_metrics(rows, ["candidate", "fold"], F.col("label"), hit).groupBy("candidate").agg(F.stddev_pop("macro_f1").alias("cv_std"), F.stddev_pop("fpr").alias("fpr_std"))
    m = E.confusion_metrics(rows, ["candidate"], F.col("label"), hit)
    out = reduce(lambda a, b: a.join(b, "candidate"), [m, folds, E.brier(rows, ["candidate"], "s"), E.curve_areas(rows, ["candidate"], "s").drop("roc_auc")])
    names = ("macro_f1", "pr_auc", "recall", "fpr", "brier", "cv_std", "fpr_std", "f1", "balanced_accuracy")
    return out.select("candidate", *[F.round(c, 9).alias(c) for c in names])


@query(CANDIDATES + " select candidate, row_number() over (order by macro_f1 desc, pr_auc desc nulls last, recall desc, fpr, brier nulls last, cv_std nulls last, candidate desc) as place from me")
def ml6_select_model(s, d):
    return S.select_model(candidates(s, d)).select("candidate", "place")


_BY = {"1.0.0": "within_limit desc, pr_auc desc, f1 desc, recall desc, balanced_accuracy desc, fpr, fpr_std", "1.0.1": "f1 desc, recall desc, pr_auc desc, balanced_accuracy desc, fpr, n_estimators, max_samples, max_features", "2.0.0": "f1 desc, recall desc, pr_auc desc, balanced_accuracy desc, fpr"}


@query(CANDIDATES + ", an as (select *, fpr <= 0.3 as within_limit, length(candidate) as n_estimators, 1.0 as max_samples, 1.0 as max_features from me)" + " union all ".join(f" select '{p}' as policy, candidate, row_number() over (order by {by}, candidate) as place from an {'' if p == '1.0.0' else 'where f1 > 0 and recall > 0'}" for p, by in _BY.items()))
def ml12_select_anomaly_model(s, d):
    rows = candidates(s, d).withColumns({"within_limit": F.col("fpr") <= 0.3, "n_estimators": F.length("candidate"), "max_samples": F.lit(1.0), "max_features": F.lit(1.0)})
    return reduce(DataFrame.unionByName, [S.select_anomaly_model(rows, p).select(F.lit(p).alias("policy"), "candidate", "place") for p in S.ANOMALY_POLICIES])


FAMILIES = ("family-0", "family-1", "family-2")


def family_rows(s, d):
    """Rows by time, attacks in three families; a group is of one stage."""
    year = F.year("observed_on")
    rows = A.dataset_lines(s, d).withColumns({"stage": F.when(year <= 1995, "early").when(year <= 1998, "middle").otherwise("late"), "family": F.when(F.col("label") == 1, F.concat(F.lit("family-"), (F.col("line") % 3).cast("int").cast("string"))).otherwise("benign")})
    return rows.withColumn("group_id", F.concat_ws("-", "stage", F.col("group_id").cast("string")))


@query(A.cte("rows_") + """, st as (select *, case when year(observed_on) <= 1995 then 'early' when year(observed_on) <= 1998 then 'middle' else 'late' end as stage, case when label = 1 then 'family-' || (line % 3)::int else 'benign' end as family from rows_),
 fa as (select unnest(['family-0', 'family-1', 'family-2']) as held_out), pa as (select held_out, label, case when stage = 'late' and family in ('benign', held_out) then 'evaluation' when stage = 'early' and family <> held_out then 'train' when stage = 'middle' and family <> held_out then 'validation' end as part from st, fa)
 select held_out, part, count(*) as n, sum(label)::bigint as attacks from pa where part is not null group by 1, 2""")
def ml15_family_parts(s, d):
    rows = family_rows(s, d)
    parts = reduce(DataFrame.unionByName, [S.without_family(rows, f).withColumn("held_out", F.lit(f)) for f in FAMILIES])
    return parts.groupBy("held_out", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("attacks"))


@query(None)
def ml15_leave_one_family_out(s, d):
    """Recall by held-out family, of trees with a threshold chosen on the validation rows."""

    def fit(train, validation):
        model = M.fitted(train, A.FEATURES, "decision_tree")
        best = E.select_threshold(M.with_probability(model, validation), "p", [i / 20 for i in range(1, 20)]).first()
        at = float(best["threshold"]) if best else 0.5
        return lambda rows: M.with_probability(model, rows).withColumn("hit", F.col("p") >= at)

    return S.leave_one_family_out(family_rows(s, d), FAMILIES, ["group_id"], fit).select("family", "n", F.round("recall", 6).alias("recall"), F.round("fpr", 6).alias("fpr"), F.round("macro_f1", 6).alias("macro_f1"))
