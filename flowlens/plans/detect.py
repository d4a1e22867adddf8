"""Queries from scores to alerts, groups and hypotheses."""

from pyspark.sql import functions as F

from flowlens import adapters as A
from flowlens.operators import correlate as C
from flowlens.operators import detect as D
from flowlens.operators import explain as X
from flowlens.operators import flows as W
from flowlens.plans.flows import BY, WHOLE, segmented

QUERIES, ORACLES = {}, {}
WINDOW = 5_184_000.0


def query(sql):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


BAND = "case when {x} >= 0.9 then 'critical' when {x} >= 0.7 then 'high' when {x} >= 0.4 then 'medium' when {x} >= 0.2 then 'low' when {x} >= 0 then 'informational' end"


def fused(s, d):
    x = A.detections_orders(s, d)
    return x.withColumn("fusion", F.round(F.col("supervised") * 0.75 + F.col("anomaly") * 0.25, 9))


FUSED = A.cte("detections", "flows") + ", f as (select *, round(supervised * 0.75 + anomaly * 0.25, 9) as fusion from detections)"


@query(FUSED + " select flow_id, fusion as risk, fusion >= 0.7 as alert_required from f")
def prj4_map_risk(s, d):
    return D.map_risk(fused(s, d), "fusion", 0.7).select("flow_id", "risk", "alert_required")


@query(FUSED + f" select flow_id, {BAND.format(x='fusion')} as severity from f")
def prj5_severity(s, d):
    return fused(s, d).select("flow_id", D.severity_band(F.col("fusion")).alias("severity"))


TYPE = "case when supervised >= 0.5 and anomaly >= 0.6 then 'multi_engine_suspicion' when supervised >= 0.5 then 'supervised_detection' when anomaly >= 0.6 then 'anomaly_detection' else 'behavioral_pattern' end"


@query(FUSED + f" select {TYPE} as alert_type, count(*) as n from f group by 1")
def prj6_alert_type(s, d):
    return fused(s, d).groupBy(D.alert_type(F.col("supervised"), F.col("anomaly"), 0.5, 0.6).alias("alert_type")).agg(F.count(F.lit(1)).alias("n"))


@query(FUSED + f""" select flow_id as alert_id, {TYPE} as alert_type, {BAND.format(x='fusion')} as severity, 'source_ip:' || source_ip || ',destination_ip:' || destination_ip || ',flow:' || flow_id as entities, protocol, first_seen
 from f join (select * exclude (label) from flows) using (flow_id) where fusion >= 0.7""")
def prj7_build_alerts(s, d):
    out = D.build_alerts(D.map_risk(fused(s, d), "fusion", 0.7), A.flows_orders(s, d))
    return out.select("alert_id", "alert_type", "severity", F.array_join("entities", ",").alias("entities"), "evidence.protocol", "evidence.first_seen")


@query(FUSED + " select flow_id, 'supervised' as \"column\" from f where not (supervised between 0 and 1) union all select flow_id, 'scaled' from f where not (supervised * 1.05 between 0 and 1)")
def flt6_score_violations(s, d):
    return D.score_violations(fused(s, d).withColumn("scaled", F.col("supervised") * 1.05), ["supervised", "scaled"])


@query(FUSED + " select flow_id, fusion, fusion >= 0.7 as positive, fusion >= 0.7 and label = 1 as hit from f")
def ml13_fuse(s, d):
    return fused(s, d).select("flow_id", "fusion", (F.col("fusion") >= 0.7).alias("positive"), ((F.col("fusion") >= 0.7) & (F.col("label") == 1)).alias("hit"))


_ABOVE = ", ".join(f"quantile_cont({c}, 0.95) as q95_{c}" for _, c, side in D.CATALOGUE if side == "above")
_RAISED = ", ".join(f"case when {c} > q95_{c} then '{code}' end" if side == "above" else f"case when {c} < q05_{c} and mean_inter_arrival_time > 0 then '{code}' end" for code, c, side in D.CATALOGUE)


@query(WHOLE + f""", prof as (select {_ABOVE}, quantile_cont(std_inter_arrival_time, 0.05) as q05_std_inter_arrival_time from whole where total_packets > 1),
 w as (select whole.*, prof.*, syn_ratio * 0.75 + asymmetry_score * 0.25 as risk from whole, prof)
 select k as key, segment, array_to_string(list_filter([{_RAISED}, case when syn_ratio >= 0.5 then 'SUPERVISED_HIGH_CONFIDENCE' end, case when asymmetry_score >= 0.6 then 'ANOMALY_HIGH_SCORE' end,
   case when syn_ratio >= 0.5 and asymmetry_score >= 0.6 then 'MULTI_ENGINE_SUPPORT' end, case when risk >= 0.5 then 'RISK_SCORE_ABOVE_ALERT_THRESHOLD' end], lambda x: x is not null), ',') as codes from w""")
def det1_reason_codes(s, d):
    f = W.flow_features(segmented(s, d), BY).withColumns({"supervised": F.col("syn_ratio"), "anomaly": F.col("asymmetry_score"), "risk": F.col("syn_ratio") * 0.75 + F.col("asymmetry_score") * 0.25})
    profile = X.reference_profile(f.where("total_packets > 1"), [c for _, c, _ in D.CATALOGUE])
    return D.reason_codes(f, profile, 0.5, 0.6, 0.5).select("key", "segment", F.array_join("codes", ",").alias("codes"))


ELIGIBLE = A.cte("alerts") + ", el as (select *, coalesce(verdict, 'unreviewed') as v from alerts where coalesce(verdict, 'unreviewed') not in ('false_positive', 'benign_expected'))"
ENTITIES = ELIGIBLE + """, ent as (select alert_id, 'source_ip:' || source_ip as entity from el union select alert_id, 'destination_ip:' || destination_ip from el union select alert_id, 'pair:' || source_ip || '->' || destination_ip from el)"""
CLUSTERS = ENTITIES + f""", o as (select entity, alert_id, event_start, event_end, row_number() over (partition by entity order by event_start, alert_id) as i from ent join el using (alert_id)),
 g as (select entity, alert_id, i, 0::bigint as cluster, event_start + {int(WINDOW * 1e6)} as lim from o where i = 1
       union all select o.entity, o.alert_id, o.i, g.cluster + (o.event_end > g.lim)::bigint, case when o.event_end > g.lim then o.event_start + {int(WINDOW * 1e6)} else g.lim end from g join o on o.entity = g.entity and o.i = g.i + 1),
 c as (select entity, cluster, alert_id from g qualify count(*) over (partition by entity, cluster) >= 2), full_ as (select * from c join el using (alert_id)),
 gaps as (select *, (event_start - lag(event_start) over (partition by entity, cluster order by event_start, alert_id)) / 1e6 as gap from full_),
 reg as (select entity, cluster, case when count(gap) >= 2 and avg(gap) > 0 then 1 - (max(gap) - min(gap)) / avg(gap) end as regularity from gaps group by 1, 2),
 facts as (select entity, cluster, count(distinct source_ip) as s, count(distinct destination_ip) as d, bool_or(regexp_matches(lower(reason), 'fail|denied|reject|reset|rst|auth')) as fails, bool_or(alert_type = 'multi_engine_suspicion') as multi, count(distinct reason) as reasons from full_ group by 1, 2),
 rules as (select entity, cluster, list_filter([case when d = 1 and s >= 2 then 'destination_fan_in' end, case when reasons >= 1 then 'multi_alert_accumulation' end, case when multi then 'multi_engine_evidence' end,
   case when regularity >= 0.8 then 'periodic_beacon_like_activity' end, case when entity like 'pair:%' and fails then 'repeated_source_destination_failures' end, case when s = 1 and d >= 2 then 'source_centered_reconnaissance' end, case when s = 1 and d >= 2 then 'source_fan_out' end], lambda x: x is not null) as rules from facts join reg using (entity, cluster)),
 sets as (select entity, cluster, string_agg(alert_id::varchar, ',' order by alert_id::varchar) as members from c group by 1, 2),
 merged as (select members, list_sort(list_distinct(list(entity))) as entities, list_sort(list_distinct(flatten(list(rules)))) as rules from sets join rules using (entity, cluster) group by 1),
 pick as (select members, min(entity || '|' || cluster) as at from sets group by 1),
 one as (select sets.members, entity, cluster from sets join pick on pick.members = sets.members and pick.at = entity || '|' || cluster),
 base as (select members, count(*) as alerts, avg(risk) as risk, count(distinct reason) as reasons, lower(string_agg(reason, ',')) as codes, min(event_start) as first_seen, max(event_end) as last_seen from one join full_ using (entity, cluster) group by 1),
 scored as (select *, round(least(1, greatest(0, risk)) * 0.35 + least(1, alerts / 5) * 0.20 + least(1, (reasons + len(rules)) / 6) * 0.25 + least(1, greatest(0, 1 - (last_seen - first_seen) / 1e6 / {WINDOW})) * 0.20, 6) as score from merged join base using (members)),
 groups_ as (select *, case when score >= 0.9 then 'critical' when score >= 0.7 then 'high' when score >= 0.5 then 'medium' when score >= 0.35 then 'low' else 'informational' end as severity from scored where score >= 0.35)"""


@query(ELIGIBLE + " select alert_id, v as verdict from el")
def flt5_eligible_alerts(s, d):
    return C.eligible_alerts(A.alerts_orders(s, d)).select("alert_id", "verdict")


@query(ELIGIBLE + """, w as (select *, ['tcp', 'udp', 'icmp'][alert_id % 3 + 1] as protocol from el), e as (select alert_id, unnest(['source_ip:' || source_ip, 'destination_ip:' || destination_ip, 'source_host:host-' || alert_id % 7,
 'protocol:' || protocol, case when alert_id % 4 <> 0 then 'service:svc-' || alert_id % 4 end, 'flow_id:' || alert_id, 'pair:' || source_ip || '->' || destination_ip]) as entity from w) select alert_id, entity from e where entity is not null""")
def prj9_observed_entities(s, d):
    k = F.col("alert_id")
    extra = {"source_host": F.concat(F.lit(" Host-"), k % 7), "protocol": F.element_at(F.array(F.lit("TCP "), F.lit("Udp"), F.lit("icmp")), (k % 3 + 1).cast("int")), "service": F.when(k % 4 == 0, "  ").otherwise(F.concat(F.lit("SVC-"), k % 4)), "flow_id": k}
    return C.observed_entities(C.eligible_alerts(A.alerts_orders(s, d)).withColumns(extra))


@query(A.cte("alerts") + " select alert_id, 'unknown_verdict' as rule from alerts where coalesce(verdict, 'unreviewed') not in ('unreviewed', 'true_positive')")
def flt5_verdict_violations(s, d):
    return C.verdict_violations(A.alerts_orders(s, d), ("unreviewed", "true_positive"))


@query(ENTITIES + " select entity, count(*) as alerts, min(event_start) as first_seen from ent join el using (alert_id) group by 1")
def cor1_entity_index(s, d):
    use = C.eligible_alerts(A.alerts_orders(s, d))
    return C.observed_entities(use).join(use, "alert_id").groupBy("entity").agg(F.count(F.lit(1)).alias("alerts"), F.min("event_start").alias("first_seen"))


def clusters(s, d):
    use = C.eligible_alerts(A.alerts_orders(s, d))
    found = C.anchored_windows(C.observed_entities(use).join(use.select("alert_id", "event_start", "event_end"), "alert_id"), WINDOW)
    return found.join(use, "alert_id")


@query(CLUSTERS + " select entity, cluster, alert_id from c")
def win5_anchored_windows(s, d):
    return clusters(s, d).select("entity", "cluster", "alert_id")


@query(CLUSTERS + " select entity, cluster, round(regularity, 6) as regularity from reg")
def win11_regularity(s, d):
    return C.regularity(clusters(s, d)).withColumn("regularity", F.round("regularity", 6))


@query(CLUSTERS + " select entity, cluster, array_to_string(rules, ',') as rules from rules")
def cor2_rules(s, d):
    return C.matched_rules(clusters(s, d)).withColumn("rules", F.array_join("rules", ","))


def group_key():
    """A group's list of members by its digest, for rows of single members."""
    return F.sha2("members", 256).alias("group")


def groups(s, d):
    return C.alert_groups(A.alerts_orders(s, d), WINDOW).withColumn("members", F.array_join("members", ","))


@query(CLUSTERS + " select members, score from scored where score >= 0.35")
def cor3_score(s, d):
    return groups(s, d).select("members", "score")


@query(CLUSTERS + " select members, array_to_string(entities, ',') as entities, array_to_string(rules, ',') as rules, alerts, first_seen, last_seen, score, severity from groups_")
def cor4_alert_groups(s, d):
    return groups(s, d).select("members", F.array_join("entities", ",").alias("entities"), F.array_join("rules", ",").alias("rules"), "alerts", "first_seen", "last_seen", "score", "severity")


@query(CLUSTERS + " select members, len(entities) as entities, array_to_string(rules, ',') as rules from merged")
def set4_merge_member_sets(s, d):
    out = C.alert_groups(A.alerts_orders(s, d), WINDOW, least_score=0.0)
    return out.select(F.array_join("members", ",").alias("members"), F.size("entities").cast("long").alias("entities"), F.array_join("rules", ",").alias("rules"))


HYP = CLUSTERS + """, h0 as (select *, list_filter([
   case when list_contains(rules, 'periodic_beacon_like_activity') and list_contains(rules, 'multi_engine_evidence') then 'possible_command_and_control_pattern' end,
   case when regexp_matches(codes, 'exfil|outbound') then 'possible_data_exfiltration_pattern' end,
   case when regexp_matches(codes, 'auth|credential|account') then 'possible_credential_abuse' end,
   case when list_contains(rules, 'repeated_source_destination_failures') then 'possible_brute_force_activity' end,
   case when list_contains(rules, 'source_centered_reconnaissance') or list_contains(rules, 'source_fan_out') then 'possible_network_reconnaissance' end,
   case when list_contains(rules, 'destination_fan_in') then 'possible_denial_of_service_behavior' end,
   case when list_contains(rules, 'periodic_beacon_like_activity') then 'possible_beaconing_behavior' end], lambda x: x is not null) as found_ from groups_ where alerts >= 2 and score >= 0.5 and len(rules) > 0),
 h as (select *, case when len(found_) = 0 then ['unclassified_behavioral_anomaly'] else found_ end as cand from h0)"""


@query(CLUSTERS + " select members, case when alerts < 2 then 'too_few_alerts' when score < 0.5 then 'low_score' when len(rules) = 0 then 'no_rules' else 'passed' end as gate from groups_")
def hyp1_gate(s, d):
    gate = F.when(F.col("alerts") < 2, "too_few_alerts").when(F.col("score") < 0.5, "low_score").when(F.size("rules") == 0, "no_rules").otherwise("passed")
    return groups(s, d).select("members", gate.alias("gate"))


@query(HYP + " select members, cand[1] as template, len(cand) as candidates from h")
def hyp2_templates(s, d):
    return C.hypotheses(groups(s, d)).drop("confidence")


@query(HYP + """ select members, round(least(1, greatest(0, 0.40 * score + 0.25 * greatest(0.2, 1 - 0.15 * (greatest(len(cand), 1) - 1)) + 0.20 * least(1.0, len(rules) / 4) + 0.15 * (len(entities) > 0)::int)), 6) as confidence from h""")
def hyp3_confidence(s, d):
    return C.hypotheses(groups(s, d)).select("members", "confidence")


@query(HYP + """ select members, cand[1] as template, len(cand) as candidates,
 round(least(1, greatest(0, 0.40 * score + 0.25 * greatest(0.2, 1 - 0.15 * (greatest(len(cand), 1) - 1)) + 0.20 * least(1.0, len(rules) / 4) + 0.15 * (len(entities) > 0)::int)), 6) as confidence from h""")
def hyp4_hypotheses(s, d):
    return C.hypotheses(groups(s, d))


@query(HYP + ", x as (select unnest(string_split(members, ','))::bigint as alert_id, members from groups_) select alert_id, members, cand[1] as template from x left join h using (members)")
def join4_alert_relations(s, d):
    g = groups(s, d)
    # groups are joined before they are taken apart, as each of their alerts repeats the whole list
    h = C.hypotheses(g).select(group_key(), "template")
    return g.withColumn("group", group_key()).join(h, "group", "left").select(F.explode(F.split("members", ",").cast("array<bigint>")).alias("alert_id"), "members", "template")


@query(CLUSTERS + ", x as (select unnest(string_split(members, ','))::bigint as alert_id, members from groups_) select distinct members from x where alert_id in (select o_orderkey from orders where o_custkey % 5 = 3)")
def join5_job_lineage(s, d):
    g = groups(s, d).select(group_key(), "members")
    ids = g.select("group", F.explode(F.split("members", ",").cast("array<bigint>")).alias("flow_id"))
    held = ids.join(A.detections_orders(s, d).where("job_id = 3").select("flow_id"), "flow_id", "left_semi").select("group").distinct()
    return g.join(held, "group", "left_semi").select("members")


@query(CLUSTERS + ", x as (select members, unnest(string_split(members, ','))::bigint as alert_id from groups_) select members, count(*) as listed, count(a.alert_id) as present, count(*) = count(a.alert_id) as consistent from x left join alerts a on a.alert_id = x.alert_id group by 1")
def join10_group_members(s, d):
    g = groups(s, d).select(group_key(), "members")
    ids = g.select("group", F.explode(F.split("members", ",")).alias("id"))
    a = A.alerts_orders(s, d).select("alert_id")
    counts = ids.join(a, F.col("id").cast("long") == F.col("alert_id"), "left").groupBy("group").agg(F.count(F.lit(1)).alias("listed"), F.count("alert_id").alias("present"))
    return g.join(counts, "group").select("members", "listed", "present", (F.col("listed") == F.col("present")).alias("consistent"))
