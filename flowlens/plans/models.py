"""Queries of trained models."""

from pyspark.sql import functions as F

from flowlens import adapters as A
from flowlens.operators import dataset as D
from flowlens.operators import explain as X
from flowlens.operators import flows as W
from flowlens.operators import isolation as I
from flowlens.operators import metrics as E
from flowlens.operators import models as M
from flowlens.operators.tables import stored
from flowlens.plans.flows import BY, segmented

QUERIES, ORACLES = {}, {}
K, SEED = 3, 42


def query(sql):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


FOLDS = A.cte("rows_") + f""", z as (select group_id, count(*) as n, row_number() over (order by count(*) desc, group_id) as i from rows_ group by 1),
 f as (select 0::bigint as i, null::bigint as group_id, null::bigint as fold, {[0] * K}::bigint[] as sums
       union all select z.i, z.group_id, list_position(sums, list_min(sums)) - 1, list_transform(range(1, {K + 1}), lambda x: sums[x] + case when x = list_position(sums, list_min(sums)) then n else 0 end) from f join z on z.i = f.i + 1)
 select group_id, fold from f where i > 0"""


def parts(s, d):
    """Rows by split; whole groups fall into each. Fits pass over them many times, so that they are stored."""
    rows = A.dataset_lines(s, d).select("record_id", "group_id", "label", *A.FEATURES)
    split = D.group_split(rows, "group_id", SEED)
    dealt = stored(rows.join(split, "group_id"), "parts")
    return {n: dealt.where(F.col("split") == n) for n in ("train", "validation", "test")}


@query(FOLDS)
def ml2_group_folds(s, d):
    return M.group_folds(A.dataset_lines(s, d), "group_id", K)


@query(None)
def ml3_tune(s, d):
    train = parts(s, d)["train"]
    names = ("decision_tree", "logistic_regression", "random_forest")
    return M.tune(train, A.FEATURES, M.group_folds(train, "group_id", K), "group_id", names)


@query(None)
def ml4_calibrate(s, d):
    p = parts(s, d)
    return M.calibrate(M.with_probability(M.fitted(p["train"], A.FEATURES, "decision_tree"), p["validation"]))[0]


def flows_by_split(s, d):
    """Flows of packets with their features and splits by key; every third key by checksum counts as an attacker's."""
    f = W.flow_features(segmented(s, d), BY).withColumns({"flow_id": F.concat_ws("#", "key", "segment"), "label": (F.crc32("key") % 3 == 0).cast("long")})
    # each fit reads them again
    f = f.persist()
    dealt = f.join(D.group_split(f, "key", SEED), "key")
    return {n: dealt.where(F.col("split") == n) for n in ("train", "validation", "test")}


def engines(s, d):
    """(parts of the flows, what adds all scores to flows, the benign training flows' profile)."""
    p, names = flows_by_split(s, d), list(W.FEATURES)
    benign = p["train"].where("label = 0")
    model = M.fitted(p["train"], names, "decision_tree")
    _, calibrated = M.calibrate(M.with_probability(model, p["validation"]))
    forest = I.fit_forest(benign, "flow_id", names)
    ranks = M.benign_ranks(benign.withColumn("raw", I.isolation_score(forest)), "raw")
    return p, (lambda flows: M.score_flows(flows, model, calibrated, I.isolation_score(forest), ranks=ranks)), X.reference_profile(benign, names)


@query(None)
def ml7_isolation_forest(s, d):
    """Anomaly scores of all rows by a forest of the benign training rows."""
    p = parts(s, d)
    forest = I.fit_forest(p["train"].where("label = 0"), "record_id", A.FEATURES)
    return A.dataset_lines(s, d).select("record_id", F.round(I.isolation_score(forest), 9).alias("score"))


@query(None)
def ml20_score_flows(s, d):
    p, score, _ = engines(s, d)
    return score(p["test"]).select("flow_id", "supervised", "anomaly", "fusion")


@query(None)
def det2_detect(s, d):
    """Detections of the test flows by models of the training flows, calibrated on the validation flows."""
    p, score, profile = engines(s, d)
    return M.detections(p["test"], "flow_id", W.FEATURES, score, profile)


#: a score that SQL can say as well: a clamped line over the features
LINE = {"quantity": 0.012, "price": 0.000004, "discount": 2.5, "tax": -1.5, "line": 0.01}
LINE_SQL = "least(1.0, greatest(0.0, " + " + ".join(f"{w} * {c}" for c, w in LINE.items()) + "))"


def line_score(rows, out="risk"):
    from functools import reduce

    total = reduce(lambda a, b: a + b, [F.lit(w) * F.col(c) for c, w in LINE.items()])
    return rows.withColumn(out, F.least(F.lit(1.0), F.greatest(F.lit(0.0), total)))


#: some rows repeat an id
OWN_SQL = "record_id || '-' || quantity::bigint || '-' || round(price * 100)::bigint"


def lines(s, d):
    own = F.concat_ws("-", "record_id", F.col("quantity").cast("long"), F.round(F.col("price") * 100).cast("long"))
    return A.dataset_lines(s, d).withColumn("record_id", own)


PROFILE_SQL = A.cte("rows_") + f""", own as (select * exclude (record_id), {OWN_SQL} as record_id from rows_), long as (unpivot (select record_id, label, quantity, price, discount, tax, line from own) on quantity, price, discount, tax, line into name feature value value),
 prof as (select feature, quantile_cont(value, 0.05) as lo, quantile_cont(value, 0.5) as median, quantile_cont(value, 0.95) as hi from long where label = 0 group by 1)"""
CONTRIBUTED = PROFILE_SQL + f""", each as (select record_id, feature, list_position(['quantity', 'price', 'discount', 'tax', 'line'], feature) - 1 as i, value as observed, median, {LINE_SQL} as risk,
   least(1.0, greatest(0.0, {" + ".join(f"{w} * case when feature = '{c}' then median else {c} end" for c, w in LINE.items())})) as replaced from long join prof using (feature) join own using (record_id)),
 dl as (select *, case when abs(risk - replaced) <= 1e-12 then 0 else risk - replaced end as delta from each)"""


def contributions(s, d, k):
    rows = lines(s, d)
    return X.local_contributions(rows, "record_id", A.FEATURES, X.reference_profile(rows.where("label = 0"), A.FEATURES), line_score, k)


@query(CONTRIBUTED + """ select record_id, feature, round(observed, 6) as observed, round(median, 6) as median, round(delta, 9) as delta,
 case when delta > 0 then 'increases_suspicion' when delta < 0 then 'decreases_suspicion' else 'neutral' end as direction from dl""")
def ml19_local_contributions(s, d):
    x = contributions(s, d, len(A.FEATURES)).select("record_id", F.explode("contributions").alias("x")).select("record_id", "x.*")
    return x.select("record_id", "feature", F.round("observed", 6).alias("observed"), F.round("median", 6).alias("median"), F.round("delta", 9).alias("delta"), "direction")


@query(CONTRIBUTED + " select record_id, string_agg(feature, ',' order by abs(delta) desc, i) as features from (select * from dl qualify row_number() over (partition by record_id order by abs(delta) desc, i) <= 3) group by 1")
def srt4_top_contributions(s, d):
    return contributions(s, d, 3).select("record_id", F.array_join(F.transform("contributions", lambda x: x["feature"]), ",").alias("features"))


REPEATS = 2
PERMUTED = A.cte("rows_") + f""", v as (select * exclude (record_id), {OWN_SQL} as record_id from rows_ where group_id % 5 = 0), gr as (select unnest(['quantity', 'price', 'discount', 'tax', 'line']) as feature), re as (select unnest(range({REPEATS})) as repeat),
 base as (select *, row_number() over (order by sha256('{SEED}::' || record_id)) as place from v),
 given as (select feature, repeat, case feature when 'quantity' then quantity when 'price' then price when 'discount' then discount when 'tax' then tax else line end as value,
   row_number() over (partition by feature, repeat order by sha256('{SEED}:from:' || feature || ':' || repeat || ':' || record_id)) as place from v, gr, re),
 perm as (select record_id, label, feature, repeat, {", ".join(f"case when feature = '{c}' then value else {c} end as {c}" for c in LINE)} from base join given using (place)),
 sc as (select feature, repeat, label, {LINE_SQL} >= 0.5 as hit from perm union all select 'base', 0, label, {LINE_SQL} >= 0.5 from v),
 cm as (select feature, repeat, count(*) filter (hit and label = 1) as tp, count(*) filter (hit and label = 0) as fp, count(*) filter (not hit and label = 1) as fn, count(*) filter (not hit and label = 0) as tn from sc group by 1, 2),
 f1 as (select feature, repeat, (case when 2 * tp + fp + fn = 0 then 0 else 2 * tp / (2 * tp + fp + fn) end + case when 2 * tn + fp + fn = 0 then 0 else 2 * tn / (2 * tn + fp + fn) end) / 2 as value from cm)"""


@query(PERMUTED + " select a.feature, round(avg(b.value - a.value), 9) as mean, round(stddev_pop(b.value - a.value), 9) as std from f1 a, f1 b where a.feature <> 'base' and b.feature = 'base' group by 1")
def agg26_permutation_importance(s, d):
    """On the rows of every fifth group, which stand for the validation part."""
    metric = lambda rows, by: E.confusion_metrics(rows, by, F.col("label"), F.col("p") >= 0.5).select(*by, F.col("macro_f1").alias("value"))
    rows = lines(s, d).where("group_id % 5 = 0").select("record_id", "label", *A.FEATURES)
    out = X.permutation_importance(rows, "record_id", A.FEATURES, lambda r: line_score(r, "p"), metric, REPEATS, SEED)
    return out.select("feature", F.round("mean", 9).alias("mean"), F.round("std", 9).alias("std"))


@query(None)
def agg27_tree_importance(s, d):
    rows = X.tree_importance(M.fitted(parts(s, d)["train"], A.FEATURES, "decision_tree"), A.FEATURES)
    return s.createDataFrame(rows, "feature string, status string, importance double")
