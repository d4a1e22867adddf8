"""Queries over flows, detections and alerts."""

from pyspark.sql import functions as F

from flowlens import adapters as A
from flowlens.operators import explore as X

QUERIES, ORACLES = {}, {}


def query(sql):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


FROM = 946_684_800_000_000


@query(A.cte("flows", "detections", "alerts") + f""" select flow_id, source_ip, destination_ip, packets from flows where protocol = 'tcp' and first_seen >= {FROM}
 and flow_id in (select flow_id from detections where supervised >= 0.9 and anomaly >= 0.2) and flow_id in (select alert_id from alerts)""")
def flt1_filter_flows(s, d):
    out = X.filter_flows(A.flows_orders(s, d), A.detections_orders(s, d), A.alerts_orders(s, d), protocol="tcp", first_from=FROM, risk=0.9, anomaly=0.2, has_alert=True)
    return out.select("flow_id", "source_ip", "destination_ip", "packets")


@query(A.cte("alerts") + " select alert_id, alert_type, risk from alerts where risk >= 0.95 and alert_type = 'multi_engine_suspicion' order by event_start desc, alert_id limit 50")
def flt4_filter_alerts(s, d):
    return X.page(A.alerts_orders(s, d).where("risk >= 0.95 and alert_type = 'multi_engine_suspicion'"), [F.desc("event_start"), F.col("alert_id")], 50).select("alert_id", "alert_type", "risk")


@query(A.cte("flows", "detections") + " select flow_id, protocol, supervised, anomaly from flows join detections using (flow_id)")
def join1_flows_with_detection(s, d):
    return X.with_detection(A.flows_orders(s, d), A.detections_orders(s, d)).select("flow_id", "protocol", "supervised", "anomaly")


@query(A.cte("flows", "alerts") + " select flow_id, protocol from flows where flow_id not in (select alert_id from alerts)")
def join2_flows_without_alert(s, d):
    return X.by_alert_presence(A.flows_orders(s, d), A.alerts_orders(s, d), False).select("flow_id", "protocol")


@query(A.cte("flows", "detections") + " select flow_id, source_id from flows where flow_id in (select flow_id from detections where job_id = 3)")
def join3_job_scope(s, d):
    return X.in_job_scope(A.flows_orders(s, d), A.detections_orders(s, d), 3).select("flow_id", "source_id")


@query(A.cte("flows") + " select count(*) as flows, sum(packets)::bigint as packets, sum(bytes)::bigint as bytes, min(first_seen) as first_seen, max(last_seen) as last_seen from flows")
def agg5_flow_summary(s, d):
    return X.flow_summary(A.flows_orders(s, d))


@query(A.cte("detections") + " select b::bigint as bucket, count(anomaly) as n from range(10) r(b) left join detections on b = least(floor(anomaly * 10), 9) group by 1")
def agg6_score_histogram(s, d):
    return X.score_histogram(A.detections_orders(s, d), "anomaly")


@query(A.cte("detections", "alerts") + """ select job_id, count(distinct flow_id) as flows, count(distinct alert_id) as alerts, round(count(distinct alert_id) / count(distinct flow_id), 6) as alert_rate
 from detections left join alerts on flow_id = alert_id group by 1""")
def agg7_job_statistics(s, d):
    return X.job_statistics(A.detections_orders(s, d), A.alerts_orders(s, d))


@query(A.cte("flows") + " select flow_id, first_seen from flows order by first_seen, flow_id limit 50 offset 100")
def srt1_page(s, d):
    return X.page(A.flows_orders(s, d), [F.col("first_seen"), F.col("flow_id")], 50, 100).select("flow_id", "first_seen")


@query(A.cte("alerts") + " select alert_id, row_number() over (order by event_start desc, alert_id) as place from alerts qualify place <= 100")
def srt2_stable_order(s, d):
    from pyspark.sql import Window

    top = X.page(A.alerts_orders(s, d), [F.desc("event_start"), F.col("alert_id")], 100)
    return top.select("alert_id", F.row_number().over(Window.orderBy(F.desc("event_start"), "alert_id")).cast("long").alias("place"))


@query(A.cte("flows") + " select source_ip, destination_ip, count(*) as flows from flows group by 1, 2 order by 3 desc, 1, 2 limit 20")
def srt3_top_pairs(s, d):
    return X.top_pairs(A.flows_orders(s, d))


RISKY = " case when supervised >= 0.9 then 'critical' when supervised >= 0.7 then 'high' when supervised >= 0.4 then 'medium' when supervised >= 0.2 then 'low' else 'informational' end "


@query(A.cte("flows", "detections") + f" select flow_id, source_ip, destination_ip, supervised as risk, {RISKY} as severity from flows join detections using (flow_id) order by risk desc, flow_id limit 100")
def srt3_top_risky_flows(s, d):
    from flowlens.operators.detect import severity_band

    joined = X.with_detection(A.flows_orders(s, d), A.detections_orders(s, d)).withColumnRenamed("supervised", "risk")
    return X.page(joined, [F.desc("risk"), F.col("flow_id")], 100).select("flow_id", "source_ip", "destination_ip", "risk", severity_band(F.col("risk")).alias("severity"))


@query(A.cte("flows", "alerts") + " select source_ip as ip, 'source' as side from flows union select destination_ip, 'destination' from alerts")
def set1_union_distinct(s, d):
    a = A.flows_orders(s, d).select(F.col("source_ip").alias("ip"), F.lit("source").alias("side"))
    return a.unionByName(A.alerts_orders(s, d).select(F.col("destination_ip").alias("ip"), F.lit("destination").alias("side"))).distinct()


@query(A.cte("scores") + " select group_id from scores where stage = 'early' intersect select group_id from scores where stage = 'late'")
def set2_intersect(s, d):
    x = A.scores_lines(s, d)
    return x.where("stage = 'early'").select("group_id").intersect(x.where("stage = 'late'").select("group_id"))


@query(A.cte("flows", "alerts") + """ select source_ip as ip, 'missing' as kind from (select source_ip from flows except select source_ip from alerts)
 union all select source_ip, 'extra' from (select source_ip from alerts except select source_ip from flows)""")
def set3_except(s, d):
    a, b = A.flows_orders(s, d).select("source_ip"), A.alerts_orders(s, d).select("source_ip")
    only = lambda x, y, k: x.distinct().join(y.distinct(), "source_ip", "left_anti").select(F.col("source_ip").alias("ip"), F.lit(k).alias("kind"))
    return only(a, b, "missing").unionByName(only(b, a, "extra"))
