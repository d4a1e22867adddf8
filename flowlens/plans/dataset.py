"""Queries about labelled rows."""

from pyspark.sql import functions as F

from flowlens import adapters as A
from flowlens.functions import scalars as S
from flowlens.operators import dataset as D
from flowlens.operators import ranks as R

QUERIES, ORACLES = {}, {}
FEATURES = list(A.FEATURES)


def query(sql):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


ROWS = A.cte("rows_")
LONG = ROWS + ", long as (unpivot (select record_id, label, quantity, price, discount, tax, line from rows_) on quantity, price, discount, tax, line into name feature value value)"


@query(LONG + """, c as (select feature, value, count(*) as c from long group by 1, 2), s as (select feature, max(c) as mode, count(*) as k from c group by 1)
 select feature, count(value) as n, 0::bigint as missing, min(value) as lo, max(value) as hi, round(avg(value), 4) as mean, round(stddev_pop(value), 3) as std, quantile_cont(value, 0.25) as q25, quantile_cont(value, 0.5) as median,
  quantile_cont(value, 0.75) as q75, any_value(k) = 1 as constant, count(value) >= 2 and any_value(mode) / count(value) >= 0.95 as near_constant from long join s using (feature) group by feature""")
def agg8_feature_statistics(s, d):
    out = D.feature_statistics(A.dataset_lines(s, d), FEATURES).drop("distinct", "mode")
    return out.withColumns({"mean": F.round("mean", 4), "std": F.round("std", 3)})


SPLIT = ROWS + """, gr as (select distinct group_id from rows_), pl as (select group_id, row_number() over (order by sha256('7:' || group_id), group_id) as r, count(*) over () as n from gr),
 ab as (select *, greatest(1, round_even(n * 0.6, 0)::bigint) as a0, greatest(1, round_even(n * 0.2, 0)::bigint) as b from pl), sp as (select group_id, case when r <= a then 'train' when r <= a + b then 'validation' else 'test' end as split from (select *, case when n - a0 - b < 1 then n - b - 1 else a0 end as a from ab)),
 asg as (select rows_.*, split from rows_ join sp using (group_id))"""


def split_rows(s, d):
    rows = A.dataset_lines(s, d)
    return rows.join(D.group_split(rows, "group_id", 7), "group_id")


@query(SPLIT + " select group_id, split from sp")
def ml1_group_split(s, d):
    return D.group_split(A.dataset_lines(s, d), "group_id", 7)


@query(SPLIT + " select group_id, sha256('7:' || group_id) as at from gr")
def srt5_stable_group_order(s, d):
    return A.dataset_lines(s, d).select("group_id").distinct().select("group_id", D.stable_order(F.col("group_id"), 7).alias("at"))


@query(SPLIT + " select split, label::varchar as \"class\", count(*) as n, round(count(*) / sum(count(*)) over (partition by split), 6) as share from asg group by 1, 2")
def agg9_class_distribution(s, d):
    return D.class_distribution(split_rows(s, d), "label")


@query(ROWS + """ select 'record_id' as kind, (count(*) - count(distinct record_id))::bigint as duplicates from rows_ union all select 'vector', (count(*) - count(distinct (quantity, price, discount, tax, line)))::bigint from rows_
 union all select 'row', (count(*) - count(distinct (record_id, quantity, price, discount, tax, line, label)))::bigint from rows_""")
def agg10_duplicates(s, d):
    return D.duplicate_counts(A.dataset_lines(s, d), {"record_id": ["record_id"], "vector": FEATURES, "row": ["record_id", *FEATURES, "label"]})


@query(ROWS + " select quantity, tax, line, count(distinct label) as labels from rows_ group by 1, 2, 3 having count(distinct label) > 1")
def agg10_conflicting_labels(s, d):
    return D.conflicting_vectors(A.dataset_lines(s, d), ["quantity", "tax", "line"], "label")


@query(SPLIT + " select observed_on::varchar as value, count(distinct split) as splits from asg group by 1 having count(distinct split) > 1")
def agg11_overlap(s, d):
    return D.overlap(split_rows(s, d).withColumn("day", F.col("observed_on").cast("string")), "day")


@query(SPLIT + " select quantity, tax, discount, count(distinct split) as splits from asg group by 1, 2, 3 having count(distinct split) > 1")
def agg12_fingerprint_overlap(s, d):
    rows = split_rows(s, d).withColumn("print", S.fingerprint([F.col("quantity"), F.col("tax"), F.col("discount")]))
    out = rows.groupBy("print").agg(F.first("quantity").alias("quantity"), F.first("tax").alias("tax"), F.first("discount").alias("discount"), F.count_distinct("split").alias("splits"))
    return out.where("splits > 1").drop("print")


@query(LONG + """, f as (select feature, value, count(distinct label) as k from long group by 1, 2), g as (select feature, count(*) as vals, max(k) as k from f group by 1)
 select feature, bool_and(value = label) as copies_label, round(corr(value, label::double), 6) as r, coalesce(abs(corr(value, label::double)) >= 0.98, false) and count(*) >= 3 as correlated,
  any_value(vals) between 2 and greatest(2, least(20, floor(sqrt(count(*))))) and any_value(g.k) = 1 and count(*) >= 4 as deterministic from long join g using (feature) group by feature""")
def agg13_label_leakage(s, d):
    return D.label_leakage(A.dataset_lines(s, d), FEATURES, "label")


@query(ROWS + " select source_file, count(*) as n, count(distinct group_id) as groups, max(observed_on)::varchar as latest from rows_ group by 1")
def agg29_dataset_manifest(s, d):
    return A.dataset_lines(s, d).groupBy("source_file").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("group_id").alias("groups"), F.max("observed_on").cast("string").alias("latest"))


@query(ROWS + " select count(*) as n, count(distinct group_id) as groups, count(distinct source_file) as files, sum(label)::bigint as positives, min(observed_on)::varchar as first_day, max(observed_on)::varchar as last_day from rows_")
def agg30_dataset_overview(s, d):
    return A.dataset_lines(s, d).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("group_id").alias("groups"), F.count_distinct("source_file").alias("files"), F.sum("label").alias("positives"), F.min("observed_on").cast("string").alias("first_day"), F.max("observed_on").cast("string").alias("last_day"))


@query(ROWS + """, ru(alias, binary_label, family) as (values ('r', 1, 'returned'), ('n', 0, 'none')) select record_id, binary_label, family, alias is null as unmapped from rows_ left join ru on lower(trim(original_label)) = alias""")
def join6_map_labels(s, d):
    rules = s.createDataFrame([("r", 1, "returned"), ("n", 0, "none")], "alias string, binary_label int, family string")
    return D.map_labels(A.dataset_lines(s, d), rules, "original_label").select("record_id", "binary_label", "family", "unmapped")


REG = [("quantity", 0.0, 45.0, True), ("discount", 0.01, 1.0, False), ("line", 1.0, 6.0, True), ("price", 0.0, 1e9, True)]
_REG = ", ".join(f"('{f}', {lo}, {hi}, {str(w).lower()})" for f, lo, hi, w in REG)


@query(LONG + f""", reg(feature, lo, hi, whole) as (values {_REG}), v as (select record_id as id, feature, case when value < lo then 'minimum' when value > hi then 'maximum' when whole and value <> floor(value) then 'integer' end as rule from long join reg using (feature))
 select * from v where rule is not null""")
def flt2_validate_features(s, d):
    registry = s.createDataFrame(REG, "feature string, lo double, hi double, whole boolean")
    return D.feature_violations(A.dataset_lines(s, d).select("record_id", *FEATURES), "record_id", registry)


@query(A.cte("flows") + """, w as (select flow_id, case when flow_id % 50 = 0 then '10.0.0.999' else source_ip end as source_ip, case when flow_id % 70 = 0 then -1 else packets end as packets, case when flow_id % 90 = 0 then first_seen - 1 else last_seen end as last_seen, first_seen from flows)
 select flow_id, 'source_ip' as rule from w where source_ip = '10.0.0.999' union all select flow_id, 'packets' from w where packets < 0 union all select flow_id, 'interval' from w where last_seen < first_seen""")
def flt3_validate_flows(s, d):
    k = F.col("flow_id")
    bad = A.flows_orders(s, d).withColumns({"source_ip": F.when(k % 50 == 0, "10.0.0.999").otherwise(F.col("source_ip")), "packets": F.when(k % 70 == 0, -1).otherwise(F.col("packets")), "last_seen": F.when(k % 90 == 0, F.col("first_seen") - 1).otherwise(F.col("last_seen"))})
    return D.flow_violations(bad)


@query(A.cte("flows") + " select flow_id, source_ip, destination_ip, protocol, packets from flows")
def flt7_drop_ground_truth(s, d):
    return A.flows_orders(s, d).drop("label").select("flow_id", "source_ip", "destination_ip", "protocol", "packets")


NEAR = A.cte("vecs") + """, pr as (select x.vec_id as a, y.vec_id as b, list_max(list_transform(range(1, len(x.features) + 1), lambda i: abs(x.features[i] - y.features[i]))) as dist from vecs x join vecs y on x.vec_id < y.vec_id
  and abs(x.features[1] - y.features[1]) <= 0.31 and abs(x.features[2] - y.features[2]) <= 0.31), e as (select a, b from pr where dist <= 0.31 and dist > 0)"""


@query(NEAR + " select a, b from e")
def join8_near_pairs(s, d):
    return D.near_pairs(A.vectors(s, d), "vec_id", "features", 0.31)


@query(NEAR + ", l as (select a, b from e union select b, a from e), reach(a, b) as (select a, b from l union select reach.a, l.b from reach join l on reach.b = l.a) select a as id, least(a, min(b)) as component from reach group by a")
def agg16_near_components(s, d):
    if s.sparkContext.getCheckpointDir() is None:
        import tempfile

        shared = s.sparkContext.getConf().get("spark.checkpoint.dir")
        if shared is None and not s.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        s.sparkContext.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return D.near_pair_components(A.vectors(s, d), "vec_id", "features", 0.31)


@query(A.cte("vecs") + """, n as (select x.vec_id as query_id, y.vec_id, list_distance(x.features, y.features) as distance from vecs x join vecs y on x.vec_id <> y.vec_id where x.vec_id % 10 = 0 and y.benign)
 select query_id, vec_id, round(distance, 9) as distance, row_number() over (partition by query_id order by distance, vec_id) as place from n qualify place <= 5""")
def join14_knn(s, d):
    v = A.vectors(s, d)
    # a query among the references would be its own nearest: one more is asked for and it is left out
    from pyspark.sql import Window

    out = D.knn(v.where("vec_id % 10 = 0"), v.where("benign"), 6).where("query_id <> vec_id")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "vec_id"))
    return out.withColumn("place", place).where("place <= 5").select("query_id", "vec_id", F.round("distance", 9).alias("distance"), F.col("place").cast("long").alias("place"))


@query("select event_id, user_id, event_type from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) <= 3")
def win12_retain_latest(s, d):
    e = A.table(s, d, "events")
    return D.retain_latest(e, ["user_id"], [F.desc("ts"), F.desc("event_id")], 3).select("event_id", "user_id", "event_type")


@query(SPLIT + " select split, count(*) as n, sum(label)::bigint as attacks, count(*) filter (label = 0) as benign from asg where split = 'train' group by 1")
def ml21_benign_train(s, d):
    x = split_rows(s, d).where("split = 'train'")
    return x.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("attacks"), F.count_if(F.col("label") == 0).alias("benign"))


@query(A.cte("vecs") + """, l as (select vec_id, benign, unnest(range(1, len(features) + 1)) as i, unnest(features) as v from vecs) select i::bigint as i, min(v) as lo, round(quantile_cont(v, 0.05), 9) as q05, round(quantile_cont(v, 0.5), 9) as median,
 round(quantile_cont(v, 0.95), 9) as q95, max(v) as hi from l where benign group by 1""")
def agg22_reference_profile(s, d):
    counts = R.value_counts(A.vectors(s, d).where("benign").select(F.posexplode("features").alias("k", "v")).select((F.col("k") + 1).cast("long").alias("i"), "v"), ["i"], "v")
    ends = counts.groupBy("i").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    out = R.exact_quantiles(counts, ["i"], {"q05": 0.05, "median": 0.5, "q95": 0.95}).join(ends, "i")
    return out.select("i", "lo", *[F.round(c, 9).alias(c) for c in ("q05", "median", "q95")], "hi")


@query("select doc_id, regexp_matches(lower(text), 'license|secret|apache') as hit, lower(trim(source)) as folded, round(case when n_chars = 0 then 0 else length(text) / n_chars end, 6) as ratio from documents")
def fn_texts(s, d):
    t = A.table(s, d, "documents")
    return t.select("doc_id", S.has_token(F.col("text"), ["LICENSE", "secret", "Apache"]).alias("hit"), S.casefold_trim(F.col("source")).alias("folded"), F.round(S.safe_ratio(F.length("text"), F.col("n_chars")), 6).alias("ratio"))


@query("select event_id, json_extract_string(props, '$.k')::bigint as k, strftime(ts, '%Y-%m-%d') as day, format('{:.6f}', value) as score, sha256('{\"event_id\":' || event_id || ',\"user_id\":' || user_id || '}') as digest, 1::bigint as depth from events")
def fn_json_dates_digests(s, d):
    e = A.table(s, d, "events")
    return e.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.date_format("ts", "yyyy-MM-dd").alias("day"), F.format_string("%.6f", "value").alias("score"), S.sha256_of(F.col("event_id"), F.col("user_id")).alias("digest"), S.json_depth(F.col("props")).cast("long").alias("depth"))


KNOTS = [(0.1, 0.0), (0.4, 0.5), (0.9, 1.0)]


@query(A.cte("detections") + " select flow_id, round(case when anomaly < 0.1 then 0.0 when anomaly > 0.9 then 1.0 when anomaly < 0.4 then (anomaly - 0.1) * (0.5 / (0.4 - 0.1)) when anomaly < 0.9 then 0.5 + (anomaly - 0.4) * (0.5 / (0.9 - 0.4)) else 1.0 end, 6) as y, least(1.0, greatest(0.0, supervised * 1.2 - 0.1)) as c from detections")
def fn8_fn10_clamp_interpolate(s, d):
    x = A.detections_orders(s, d)
    return x.select("flow_id", F.round(S.interpolate(F.col("anomaly"), KNOTS), 6).alias("y"), S.clamp01(F.col("supervised") * 1.2 - 0.1).alias("c"))
