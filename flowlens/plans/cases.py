"""Queries over feedback and cases."""

from pyspark.sql import functions as F

from flowlens import adapters as A
from flowlens.operators import cases as C

QUERIES, ORACLES = {}, {}


def query(sql):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


VERDICTS = {"purchase": "true_positive", "error": "false_positive", "signup": "benign_expected"}
FB = "fb as (select event_id as feedback_id, event_id % (select max(o_orderkey) + 1 from orders) as object_id, case event_type " + " ".join(f"when '{e}' then '{v}'" for e, v in VERDICTS.items()) + " else 'unsure' end as verdict, least(1.0, value / 100) as confidence, user_id % 9 as actor, epoch_us(ts) as micros from events)"


def feedback(s, d):
    e, most = A.table(s, d, "events"), A.table(s, d, "orders").agg((F.max("o_orderkey") + 1).alias("m"))
    verdict = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in VERDICTS.items()], F.lit("unsure"))
    return e.crossJoin(F.broadcast(most)).select(F.col("event_id").alias("feedback_id"), (F.col("event_id") % F.col("m")).alias("object_id"), verdict.alias("verdict"), F.least(F.lit(1.0), F.col("value") / 100).alias("confidence"), (F.col("user_id") % 9).alias("actor"), F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"))


@query("with " + FB + " select feedback_id, object_id, actor, verdict from fb qualify row_number() over (partition by object_id % 500, actor order by micros desc, feedback_id desc) = 1")
def win9_latest_feedback(s, d):
    f = feedback(s, d).withColumn("k", F.col("object_id") % 500)
    return C.latest_feedback(f, ["k", "actor"], "micros", "feedback_id").select("feedback_id", "object_id", "actor", "verdict")


REASON = "case when verdict = 'unsure' then 'unmapped_verdict' when confidence < 0.7 then 'low_confidence' when object_id is null then 'invalid_id' when a.alert_id is null then 'alert_missing' end"
RES = A.cte("alerts") + ", " + FB + f", res as (select fb.*, {REASON} as reason, case verdict when 'true_positive' then 'malicious' when 'unsure' then null else 'benign' end as label from fb left join (select distinct alert_id from alerts) a on a.alert_id = object_id)"


CHAIN = A.cte("alerts", "flows") + ", " + FB + f""", de as (select alert_id from alerts where alert_id % 11 <> 5), fl as (select flow_id, source_id, case when flow_id % 17 = 3 then null else packets::double end as packets, case when flow_id % 19 = 4 then 'inf'::double else bytes::double end as bytes from flows where flow_id % 13 <> 4),
 re as (select feedback_id, case when feedback_id % 23 = 0 then 'case_level' when verdict = 'unsure' then 'unmapped_verdict' when confidence < 0.7 then 'low_confidence' when object_id is null then 'invalid_id' when a.alert_id is null then 'alert_missing' when de.alert_id is null then 'detection_missing'
   when flow_id is null then 'flow_missing' when packets is null or bytes is null then 'features_incomplete' when isinf(bytes) then 'features_not_finite' when source_id = 6 then 'source_missing' when source_id = 3 then 'provenance_incomplete' when source_id = 2 then 'partition_excluded'
   when source_id = 4 then 'partition_not_eligible' when source_id = 5 then 'type_not_eligible' end as reason from fb left join (select alert_id from alerts) a on a.alert_id = object_id left join de on de.alert_id = object_id left join fl on flow_id = object_id)"""


@query(CHAIN + " select feedback_id, reason from re")
def join7_resolve_feedback(s, d):
    fb = feedback(s, d)
    fb = fb.select("feedback_id", F.when(F.col("feedback_id") % 23 == 0, "case").otherwise("alert").alias("object_type"), F.col("object_id").cast("string").alias("object_id"), "verdict", "confidence")
    alerts = A.alerts_orders(s, d).select("alert_id", F.col("alert_id").alias("detection_id"))
    k = F.col("flow_id")
    flows = A.flows_orders(s, d).where("flow_id % 13 <> 4").select("flow_id", "source_id", F.when(k % 17 != 3, F.col("packets").cast("double")).alias("packets"), F.when(k % 19 == 4, float("inf")).otherwise(F.col("bytes").cast("double")).alias("bytes"))
    kinds = ["controlled_lab"] * 5 + ["rumour"]
    sources = s.createDataFrame([(i, p, kinds[i], "d", "1", "s", "g") for i, p in enumerate(("train", "feedback", "test", "", "archive", "train"))], "source_id long, provenance_partition string, provenance_type string, dataset_id string, dataset_version string, scenario_id string, group_id string")
    detections = alerts.where("alert_id % 11 <> 5").select("detection_id", F.col("alert_id").alias("flow_id"))
    return C.resolve_candidates(fb, alerts, detections, flows, sources, ("packets", "bytes")).select("feedback_id", "reason")


@query(RES + " select object_id, case when count(distinct label) > 1 then 'conflict' else min(label) end as label, min(confidence) as confidence, count(*) as feedbacks from res where reason is null group by 1")
def fbk1_retraining_candidates(s, d):
    return C.retraining_candidates(C.resolve_feedback(feedback(s, d), A.alerts_orders(s, d)))


@query("with " + FB + " select verdict, count(*) as n, min(feedback_id) as first_id, max(feedback_id) as last_id from fb group by 1")
def agg15_export_manifest(s, d):
    return C.export_manifest(feedback(s, d))


@query(A.cte("alerts") + ", " + FB + ", nv as (select object_id as alert_id, verdict as new_verdict from fb where verdict <> 'unsure' qualify row_number() over (partition by object_id order by micros desc, feedback_id desc) = 1) select alert_id, coalesce(new_verdict, verdict) as verdict, risk from alerts left join nv using (alert_id)")
def det3_set_verdict(s, d):
    new = C.latest_feedback(feedback(s, d).where("verdict <> 'unsure'"), ["object_id"], "micros", "feedback_id")
    return C.set_verdict(A.alerts_orders(s, d), new.select(F.col("object_id").alias("alert_id"), F.col("verdict").alias("new_verdict"))).select("alert_id", "verdict", "risk")


STEPS = "st as (select user_id as case_id, event_id as step, case event_type when 'view' then 'open' when 'click' then 'in_progress' when 'purchase' then 'resolved' when 'error' then 'closed' else 'open' end as status from events)"
STATUS = {"view": "open", "click": "in_progress", "purchase": "resolved", "error": "closed"}
ALLOWED = [("open", "in_progress"), ("in_progress", "resolved"), ("resolved", "closed"), ("open", "open"), ("in_progress", "in_progress")]


def steps(s, d):
    status = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in STATUS.items()], F.lit("open"))
    return A.table(s, d, "events").select(F.col("user_id").alias("case_id"), F.col("event_id").alias("step"), status.alias("status"), F.when(F.col("value") > 100, F.col("event_type")).alias("priority"))


_ALLOWED = ", ".join(f"('{a}', '{b}')" for a, b in ALLOWED)


@query(f"with {STEPS}, l as (select case_id, step, lag(status) over (partition by case_id order by step) as was, status as now from st) select * from l where was is not null and (was, now) not in ({_ALLOWED})")
def win10_case_transitions(s, d):
    return C.transition_violations(steps(s, d), "case_id", "step", "status", ALLOWED)


HYPS = [("open", "in_progress"), ("open", "closed"), ("in_progress", "closed"), ("open", "open"), ("in_progress", "in_progress"), ("in_progress", "resolved")]


@query(f"with {STEPS}, l as (select case_id, step, lag(status) over (partition by case_id order by step) as was, status as now from st) select count(*) as violations, count(distinct case_id) as cases from l where was is not null and (was, now) not in ({', '.join(f'({a!r}, {b!r})' for a, b in HYPS)})")
def hyp5_hypothesis_transitions(s, d):
    return C.transition_violations(steps(s, d), "case_id", "step", "status", HYPS).agg(F.count(F.lit(1)).alias("violations"), F.count_distinct("case_id").alias("cases"))


@query("with st as (select user_id as case_id, event_id as step, event_type as status, case when value > 100 then event_type end as priority from events) select case_id, max(step) as step, arg_max(status, step) as status, arg_max(priority, step) filter (priority is not null) as priority from st group by 1")
def case2_case_state(s, d):
    e = A.table(s, d, "events").select(F.col("user_id").alias("case_id"), F.col("event_id").alias("step"), F.col("event_type").alias("status"), F.when(F.col("value") > 100, F.col("event_type")).alias("priority"))
    return C.case_state(e, "case_id", "step", ["status", "priority"])


@query("with n as (select o_orderkey as id, o_orderstatus || ':' || o_custkey as e from orders where o_orderkey % 3 <> 0), x as (select o_orderkey as id, case when o_orderkey % 10 = 0 then 'old' else o_orderstatus || ':' || o_custkey end as e from orders where o_orderkey % 2 = 0) select outcome, count(*) as n from (select case when x.id is null then 'inserted' when x.e = n.e then 'reused' else 'conflict' end as outcome from n left join x using (id)) group by 1")
def join12_append_new(s, d):
    o = A.table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.concat_ws(":", "o_orderstatus", "o_custkey").alias("e"))
    old = o.where("id % 2 = 0").withColumn("e", F.when(F.col("id") % 10 == 0, "old").otherwise(F.col("e")))
    return C.append_new(o.where("id % 3 <> 0"), old, "id", F.col("e")).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query("select distinct epoch_us(ts) as at, case event_type when 'view' then 'audit' when 'click' then 'feedback' else 'note' end as kind, user_id % 9 as actor from events where user_id % 100 = 7")
def join11_case_timeline(s, d):
    e = A.table(s, d, "events").select((F.col("user_id") % 100).cast("string").alias("case_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), (F.col("user_id") % 9).alias("actor"), "event_type")
    return C.timeline(e.where("event_type = 'view'"), e.where("event_type = 'click'"), e.where("event_type not in ('view', 'click')"), "7")


@query("select event_id, '{\"k\":\"' || json_extract_string(props, '$.k') || '\"}' as details from events")
def prj8_audit_projection(s, d):
    return C.audit_projection(A.table(s, d, "events"), "props").select("event_id", "details")


@query(A.cte("alerts") + " select alert_id as case_id, case when risk >= 0.95 then 'p1' else 'p2' end as priority, 'open' as status from alerts where verdict is distinct from 'false_positive'")
def case1_open_cases(s, d):
    a = A.alerts_orders(s, d).where("verdict is null or verdict <> 'false_positive'")
    return a.select(F.col("alert_id").alias("case_id"), F.when(F.col("risk") >= 0.95, "p1").otherwise("p2").alias("priority"), F.lit("open").alias("status"))


@query("select sha256(text) as checksum, min(doc_id) as source_id, count(*) as copies from documents group by 1")
def src8_sources_dedup(s, d):
    return A.table(s, d, "documents").groupBy(F.sha2("text", 256).alias("checksum")).agg(F.min("doc_id").alias("source_id"), F.count(F.lit(1)).alias("copies"))


CASES = A.cte("alerts") + """, ca as (select alert_id as case_id, [alert_id, alert_id + 1, alert_id + 2] as alert_ids, event_start, event_end, verdict from alerts where risk >= 0.95),
 ev as (select event_id, user_id, event_type, epoch_us(ts) as m_, event_id % (select max(o_orderkey) + 1 from orders) as k from events),
 tg as (select case_id, 'case' as object_type, case_id as object_id from ca union select case_id, 'alert', unnest(alert_ids) from ca),
 fe as (select case_id, m_, event_id as id, event_type as detail from ev join tg on object_id = k and object_type = case when event_id % 2 = 0 then 'alert' else 'case' end where event_type <> 'view'),
 wa as (select case_id, case_id as object_id from ca union select case_id, id from fe)"""


@query(CASES + """ select case_id::varchar as case_id, 'case' as section, event_start as "at", case_id::varchar as id, concat_ws('|', event_end::varchar, verdict) as detail from ca
 union all select case_id::varchar, 'reference', event_start, unnest(alert_ids)::varchar, 'security_alert' from ca union all select case_id::varchar, 'note', m_, event_id::varchar, event_type from ev join ca on case_id = k where event_type = 'view'
 union all select case_id::varchar, 'feedback', m_, id::varchar, detail from fe union all select case_id::varchar, 'audit', m_, event_id::varchar, 'seen' from ev join wa on object_id = event_id + 1""")
def case3_case_facts(s, d):
    a = A.alerts_orders(s, d).where("risk >= 0.95")
    k = F.col("alert_id")
    cases = a.select(k.alias("case_id"), F.array(k, k + 1, k + 2).alias("alert_ids"), F.col("event_start").alias("first_seen"), F.col("event_end").alias("last_seen"), "verdict")
    most = A.table(s, d, "orders").agg((F.max("o_orderkey") + 1).alias("m"))
    e = A.table(s, d, "events").crossJoin(F.broadcast(most)).select("event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), (F.col("event_id") % F.col("m")).alias("k"))
    references = cases.select("case_id", F.explode("alert_ids").alias("id"), F.col("first_seen").alias("at"), F.lit("security_alert").alias("detail"))
    notes = e.where("event_type = 'view'").select(F.col("k").alias("case_id"), F.col("event_id").alias("id"), "at", F.col("event_type").alias("detail"))
    feedback = e.where("event_type <> 'view'").select(F.col("event_id").alias("id"), F.when(F.col("event_id") % 2 == 0, "alert").otherwise("case").alias("object_type"), F.col("k").alias("object_id"), "at", F.col("event_type").alias("detail"))
    audit = e.select((F.col("event_id") + 1).alias("object_id"), F.col("event_id").alias("id"), "at", F.lit("seen").alias("detail"))
    return C.case_facts(cases, references, notes, feedback, audit)
