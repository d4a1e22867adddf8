"""Queries of metrics and selections."""

from pyspark.sql import functions as F

from flowlens import adapters as A
from flowlens.operators import dataset as D
from flowlens.operators import metrics as M

QUERIES, ORACLES = {}, {}
GRID = [0.2, 0.4, 0.6, 0.8]


def query(sql):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


SC = A.cte("scores")
#: metrics of counts tp, fp, fn, tn in a table m
CALC = """round((tp + tn) / (tp + fp + fn + tn), 6) as accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) as precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) as recall, round(coalesce(fp / nullif(fp + tn, 0), 0), 6) as fpr,
 round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) as f1, round((coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) + coalesce(2 * tn / nullif(2 * tn + fp + fn, 0), 0)) / 2, 6) as macro_f1"""
NAMES = ("accuracy", "precision", "recall", "fpr", "f1", "macro_f1")
COUNT = "count(*) filter (label = 1 and {p}) as tp, count(*) filter (label <> 1 and {p}) as fp, count(*) filter (label = 1 and not ({p})) as fn, count(*) filter (label <> 1 and not ({p})) as tn"


def rounded(df, *names):
    return df.withColumns({c: F.round(c, 6) for c in names})


@query(SC + f", m as (select stage, {COUNT.format(p='p >= 0.5')} from scores group by 1) select stage, tp, fp, fn, tn, {CALC} from m")
def agg17_confusion_metrics(s, d):
    m = M.confusion_metrics(A.scores_lines(s, d), ["stage"], F.col("label"), F.col("p") >= 0.5)
    return rounded(m, *NAMES).select("stage", "tp", "fp", "fn", "tn", *NAMES)


AREAS = """, c as (select stage, p as s, sum(label)::double as pos, sum(1 - label)::double as neg from scores group by 1, 2), w as (select *, sum(pos) over d as tp, sum(neg) over d as fp, sum(pos) over t as pp, sum(neg) over t as nn from c
 window d as (partition by stage order by s desc rows unbounded preceding), t as (partition by stage))
 select stage, round(sum(pos * (nn - fp + neg / 2)) / (max(pp) * max(nn)), 6) as roc_auc, round(sum(pos * tp / (tp + fp)) / max(pp), 6) as pr_auc from w group by stage"""


@query(SC + AREAS)
def agg18_curve_areas(s, d):
    return rounded(M.curve_areas(A.scores_lines(s, d), ["stage"], "p"), "roc_auc", "pr_auc")


@query(SC + " select family, round(avg((p - label) * (p - label)), 6) as brier from scores group by 1")
def agg19_brier(s, d):
    return rounded(M.brier(A.scores_lines(s, d), ["family"], "p"), "brier")


@query(SC + """, g as (select group_id, avg(case when label = 0 then (a >= 0.6)::int end) as fpr, avg(case when label = 1 then (a >= 0.6)::int end) as recall from scores group by 1)
 select round(avg(fpr), 6) as fpr_mean, round(stddev_pop(fpr), 6) as fpr_std, round(avg(recall), 6) as recall_mean, round(stddev_pop(recall), 6) as recall_std, count(*) filter (fpr is null) as without_benign, count(*) filter (recall is null) as without_attack from g""")
def agg20_group_stability(s, d):
    return rounded(M.group_stability(A.scores_lines(s, d), "group_id", F.col("a") >= 0.6), "fpr_mean", "fpr_std", "recall_mean", "recall_std")


@query(SC + " select family, count(a) as n, min(a) as lo, " + ", ".join(f"round(quantile_cont(a, {q}), 6) as q{n}" for n, q in (("05", 0.05), ("25", 0.25), ("50", 0.5), ("75", 0.75), ("95", 0.95))) + ", max(a) as hi, round(avg(a), 6) as mean, round(stddev_pop(a), 6) as std from scores group by 1")
def agg21_score_distribution(s, d):
    return rounded(M.score_distribution(A.scores_lines(s, d), ["family"], "a"), "q05", "q25", "q50", "q75", "q95", "mean", "std")


_GRID = "(values " + ", ".join(f"({t}::double)" for t in GRID) + ") t(threshold)"


@query(SC + f", m as (select threshold, {COUNT.format(p='p >= threshold')} from scores cross join {_GRID} group by 1) select threshold, tp, fp, fn, tn, {CALC} from m")
def agg32_threshold_curve(s, d):
    return rounded(M.threshold_curve(A.scores_lines(s, d), "p", GRID), *NAMES).select("threshold", "tp", "fp", "fn", "tn", *NAMES)


@query(SC + f", m as (select threshold, {COUNT.format(p='p >= threshold')} from scores cross join {_GRID} group by 1), r as (select threshold, {CALC} from m) select threshold, macro_f1, recall from r order by macro_f1 desc, recall desc, fpr, round(abs(threshold - 0.5), 9), threshold limit 1")
def ml5_select_threshold(s, d):
    return rounded(M.select_threshold(A.scores_lines(s, d), "p", GRID), "macro_f1", "recall").select("threshold", "macro_f1", "recall")


@query(SC + f""", m as (select threshold, {COUNT.format(p='a >= threshold')} from scores cross join {_GRID} group by 1), r as (select threshold, (coalesce(tp / nullif(tp + fn, 0), 0) + coalesce(tn / nullif(tn + fp, 0), 0)) / 2 as bal, {CALC} from m)
 select threshold, f1, row_number() over (order by f1 desc, recall desc, round(bal, 9) desc, fpr, threshold) as place from r where fpr <= 0.45""")
def ml11_anomaly_thresholds(s, d):
    return rounded(M.anomaly_thresholds(A.scores_lines(s, d), "a", GRID, 0.45), "f1").select("threshold", "f1", "place")


FUSE = SC + f""", fu as (select *, w.weight, round(p * weight + a * (1 - weight), 9) as fused from scores cross join (values (0.25::double), (0.5::double), (0.75::double)) w(weight)),
 m as (select weight, threshold, {COUNT.format(p='fused >= threshold')} from fu cross join {_GRID} group by 1, 2)"""


@query(FUSE + f", r as (select weight, threshold, {CALC} from m) select weight, threshold, macro_f1, row_number() over (order by macro_f1 desc, recall desc, fpr, weight, threshold) as place from r where fpr <= 0.25 and recall > 0 and f1 > 0")
def ml14_select_fusion(s, d):
    return rounded(M.select_fusion(A.scores_lines(s, d), [0.25, 0.5, 0.75], GRID), "macro_f1").select("weight", "threshold", "macro_f1", "place")


@query(FUSE + " select weight, threshold, tp, fp from m")
def join9_candidate_grid(s, d):
    rows = A.scores_lines(s, d).withColumn("weight", F.explode(F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))))
    rows = rows.withColumn("fused", F.round(F.col("p") * F.col("weight") + F.col("a") * (1 - F.col("weight")), 9))
    return M.threshold_curve(rows, "fused", GRID, ["weight"]).select("weight", "threshold", "tp", "fp")


@query(SC + f", m as (select family, {COUNT.format(p='p >= 0.5')} from scores group by 1), r as (select family, {CALC} from m) select family, macro_f1, row_number() over (order by macro_f1 desc, recall desc, fpr, family) as place from r")
def win8_rank_candidates(s, d):
    m = rounded(M.confusion_metrics(A.scores_lines(s, d), ["family"], F.col("label"), F.col("p") >= 0.5), *NAMES)
    return M.best_of(m, [F.desc("macro_f1"), F.desc("recall"), F.col("fpr"), F.col("family")]).select("family", "macro_f1", "place")


@query(SC + f""", m as (select {COUNT.format(p='p >= 0.5')}, 'base' as mode from scores union all select {COUNT.format(p='round(p * 0.75 + a * 0.25, 9) >= 0.5')}, 'fusion' from scores), r as (select mode, {CALC} from m),
 l as (unpivot r on accuracy, precision, recall, fpr, f1, macro_f1 into name metric value value) select metric, round(max(value) filter (mode = 'fusion') - max(value) filter (mode = 'base'), 6) as delta from l group by 1""")
def agg23_metric_deltas(s, d):
    rows = A.scores_lines(s, d)
    m = lambda n, p: M.confusion_metrics(rows.withColumn("mode", F.lit(n)), ["mode"], F.col("label"), p)
    both = rounded(m("base", F.col("p") >= 0.5).unionByName(m("fusion", F.round(F.col("p") * 0.75 + F.col("a") * 0.25, 9) >= 0.5)), *NAMES)
    return rounded(M.metric_deltas(both, "base", "fusion", NAMES), "delta")


@query(SC + f""", m as (select family, {COUNT.format(p='p >= 0.5')} from scores group by 1), r as (select coalesce(tp / nullif(tp + fn, 0), 0) as recall, coalesce(fp / nullif(fp + tn, 0), 0) as fpr, coalesce(fn / nullif(fn + tp, 0), 0) as fnr,
 (coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) + coalesce(2 * tn / nullif(2 * tn + fp + fn, 0), 0)) / 2 as macro_f1 from m)
 select round(avg(recall), 6) as recall, round(min(recall), 6) as least, round(max(recall), 6) as most, round(avg(macro_f1), 6) as macro_f1, round(avg(fpr), 6) as fpr, round(avg(fnr), 6) as fnr, count(*) as families from r""")
def agg25_family_macro(s, d):
    m = M.confusion_metrics(A.scores_lines(s, d), ["family"], F.col("label"), F.col("p") >= 0.5)
    means = [F.avg(c).alias(c) for c in ("recall", "macro_f1", "fpr", "fnr")]
    return rounded(m.agg(*means, F.min("recall").alias("least"), F.max("recall").alias("most"), F.count(F.lit(1)).alias("families")), "recall", "macro_f1", "fpr", "fnr", "least", "most")


DRAWS = 1000
_VALUES = """case when p > 0 then tp / p end as recall, case when p > 0 then f1 end as f1, case when p > 0 and n > 0 then (f1 + f0) / 2 end as macro_f1, case when p > 0 and n > 0 then ap / p end as pr_auc, case when n > 0 then fp / n end as fpr,
 case when tp + fp > 0 then tp / (tp + fp) else 0 end as precision, case when n > 0 then tn / n end as specificity, case when p > 0 then fn / p end as fnr, (tp + tn) / (p + n) as accuracy, case when p > 0 and n > 0 then (tp / p + tn / n) / 2 end as balanced_accuracy,
 case when (tp + fp) * p * n * (tn + fn) > 0 then (tp * tn - fp * fn) / (sqrt(tp + fp) * sqrt(p) * sqrt(n) * sqrt(tn + fn)) else 0 end as mcc, case when p > 0 and n > 0 then wins / (p * n) end as roc_auc, (f1 * p + f0 * n) / (p + n) as weighted_f1"""
BOOTSTRAP = A.cte("scores") + f""", gr as (select group_id, row_number() over (order by group_id) - 1 as k, count(*) over () as n from (select distinct group_id from scores)),
 pk as (select draw, ('0x' || substr(sha256('13:' || draw || ':' || slot), 1, 13))::bigint % (select count(*) from gr) as k from (select unnest(range({DRAWS})) as draw), (select k as slot from gr)),
 ti as (select draw, group_id, count(*) as times from pk join gr using (k) group by 1, 2),
 ce as (select 'p' as mode, group_id, p as s, count(*) filter (label = 1) as pos, count(*) filter (label = 0) as neg from scores group by 2, 3 union all select 'a', group_id, a, count(*) filter (label = 1), count(*) filter (label = 0) from scores group by 2, 3),
 dr as (select draw, mode, s, sum(pos * times)::double as pos, sum(neg * times)::double as neg from ce join ti using (group_id) group by 1, 2, 3),
 cu as (select *, sum(pos) over w as up, sum(neg) over w as dn from dr window w as (partition by draw, mode order by s desc rows unbounded preceding)),
 su as (select draw, mode, coalesce(sum(pos) filter (s >= 0.5), 0) as tp, coalesce(sum(neg) filter (s >= 0.5), 0) as fp, sum(pos) as p, sum(neg) as n, sum(pos * up / (up + dn)) as ap, sum(neg * (up - pos / 2)) as wins from cu group by 1, 2),
 fs as (select *, p - tp as fn, n - fp as tn, case when tp + p + fp - tp + tp > 0 then 2 * tp / (2 * tp + fp + p - tp) else 0 end as f1, case when 2 * (n - fp) + fp + p - tp > 0 then 2 * (n - fp) / (2 * (n - fp) + fp + p - tp) else 0 end as f0 from su),
 me as (select draw, mode, {_VALUES} from fs), na as (select unnest({list(M.BOOTSTRAPPED)}) as metric),
 lo as (select draw, mode, metric, case metric {" ".join(f"when '{m}' then {m}" for m in M.BOOTSTRAPPED)} end as value from me, na),
 al as (select mode, metric, value from lo union all select 'p-a', x.metric, x.value - y.value from lo x join lo y using (draw, metric) where x.mode = 'p' and y.mode = 'a')"""


@query(BOOTSTRAP + " select mode, metric, round(quantile_cont(value, 0.025), 6) as lo, round(quantile_cont(value, 0.975), 6) as hi, count(value) as draws, count(*) - count(value) as failed from al group by 1, 2")
def agg24_group_bootstrap(s, d):
    return rounded(M.group_bootstrap(A.scores_lines(s, d), "group_id", {"p": 0.5, "a": 0.5}, DRAWS, 13, base="a"), "lo", "hi")


MODES = BOOTSTRAP + f""", c1 as (select mode, s, sum(pos)::double as pos, sum(neg)::double as neg from ce group by 1, 2), u1 as (select *, sum(pos) over w as up, sum(neg) over w as dn from c1 window w as (partition by mode order by s desc rows unbounded preceding)),
 s1 as (select mode, coalesce(sum(pos) filter (s >= 0.5), 0) as tp, coalesce(sum(neg) filter (s >= 0.5), 0) as fp, sum(pos) as p, sum(neg) as n, sum(pos * up / (up + dn)) as ap, sum(neg * (up - pos / 2)) as wins from u1 group by 1),
 f1_ as (select *, p - tp as fn, n - fp as tn, case when p + fp + tp > 0 then 2 * tp / (2 * tp + fp + p - tp) else 0 end as f1, case when 2 * (n - fp) + fp + p - tp > 0 then 2 * (n - fp) / (2 * (n - fp) + fp + p - tp) else 0 end as f0 from s1),
 m1 as (select mode, {_VALUES} from f1_), l1 as (select mode, metric, case metric {" ".join(f"when '{m}' then {m}" for m in M.BOOTSTRAPPED)} end as value from m1, na),
 a1 as (select mode, metric, value from l1 union all select 'p-a', x.metric, x.value - y.value from l1 x join l1 y using (metric) where x.mode = 'p' and y.mode = 'a'),
 iv as (select mode, metric, quantile_cont(value, 0.025) as lo, quantile_cont(value, 0.975) as hi, count(*) - count(value) as failed from al group by 1, 2)"""


@query(MODES + " select mode, metric, round(value, 6) as value, round(lo, 6) as lo, round(hi, 6) as hi, failed from a1 join iv using (mode, metric)")
def ml17_evaluate_modes(s, d):
    return rounded(M.evaluate_modes(A.scores_lines(s, d), "group_id", {"p": 0.5, "a": 0.5}, DRAWS, 13, "a"), "value", "lo", "hi")


SHIFTED = A.cte("rows_") + ", sh as (select * replace (round_even(quantity * 1.5, 0) as quantity, price / 1.5 as price, 'duration-' || group_id as group_id) from rows_)"


@query(SHIFTED + " select record_id, group_id, quantity, round(price, 6) as price from sh")
def prj3_parameter_shift(s, d):
    return M.parameter_shift(A.dataset_lines(s, d), "duration", 1.5, ["quantity"]).select("record_id", "group_id", "quantity", F.round("price", 6).alias("price"))


@query(SHIFTED + """ select 'before' as side, min(quantity) as quantity_lo, max(quantity) as quantity_hi, round(min(price), 6) as price_lo, round(max(price), 6) as price_hi from rows_
 union all select 'after', min(quantity), max(quantity), round(min(price), 6), round(max(price), 6) from sh""")
def agg28_shift_ranges(s, d):
    rows = A.dataset_lines(s, d)
    ends = lambda df, n: df.agg(F.min("quantity").alias("quantity_lo"), F.max("quantity").alias("quantity_hi"), F.round(F.min("price"), 6).alias("price_lo"), F.round(F.max("price"), 6).alias("price_hi")).withColumn("side", F.lit(n))
    return ends(rows, "before").unionByName(ends(M.parameter_shift(rows, "duration", 1.5, ["quantity"]), "after"))


@query("with e as (select min(o_totalprice) as lo, max(o_totalprice) as hi from orders), c as (select least(floor((o_totalprice - lo) / (hi - lo) * 15), 14)::bigint as bin, count(*) as n from orders cross join e group by 1) select b::bigint as bin, coalesce(n, 0) as n from range(15) r(b) left join c on c.bin = b")
def agg31_histogram(s, d):
    return M.histogram(A.table(s, d, "orders"), "o_totalprice", 15)


@query(SC + ", c as (select a as score, count(*) as c from scores where label = 0 group by 1) select score, round((sum(c) over (order by score rows unbounded preceding) - c / 2) / sum(c) over (), 9) as rank from c")
def ml10_empirical_cdf(s, d):
    return M.empirical_cdf(A.scores_lines(s, d).where("label = 0"), "a").withColumn("rank", F.round("rank", 9))


@query(SC + " select p, 0.0 - p as canonical, count(*) as n from scores group by 1, 2")
def ml9_canonical_score(s, d):
    return A.scores_lines(s, d).groupBy("p", (0.0 - F.col("p")).alias("canonical")).agg(F.count(F.lit(1)).alias("n"))


@query(A.cte("rows_") + ", st as (select case when year(observed_on) <= 1995 then 'early' when year(observed_on) <= 1998 then 'middle' else 'late' end as stage, observed_on from rows_) select stage, count(*) as n, min(observed_on)::varchar as first_day, max(observed_on)::varchar as last_day from st group by 1")
def ml16_temporal_holdout(s, d):
    y = F.year("observed_on")
    rows = A.dataset_lines(s, d).withColumn("stage", F.when(y <= 1995, "early").when(y <= 1998, "middle").otherwise("late"))
    return rows.groupBy("stage").agg(F.count(F.lit(1)).alias("n"), F.min("observed_on").cast("string").alias("first_day"), F.max("observed_on").cast("string").alias("last_day"))


#: novelty of every vector against the benign others: the k nearest references and their own reach
LOF = A.cte("vecs") + """, re as (select * from vecs where benign), qr as (select x.vec_id as a, x.benign, y.vec_id as b, list_distance(x.features, y.features) as dist from vecs x join re y on x.vec_id <> y.vec_id),
 nq as (select *, row_number() over (partition by a order by dist, b) as k from qr qualify k <= 5), kd as (select a as id, max(dist) as kdist from nq where benign group by 1),
 own as (select nq.a as id, 1 / (avg(greatest(dist, kdist)) + 1e-10) as lrd from nq join kd on kd.id = nq.b group by 1)
 select nq.a as vec_id, round(-avg(o.lrd) / any_value(q.lrd), 6) as score from nq join own o on o.id = nq.b join own q on q.id = nq.a group by 1"""


@query(LOF)
def ml8_lof_novelty(s, d):
    return D.lof_novelty(A.vectors(s, d), 5).withColumn("score", F.round("score", 6))
