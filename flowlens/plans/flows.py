"""Queries over packets and segments."""

from pyspark.sql import functions as F

from flowlens import adapters as A
from flowlens.operators import flows as W

QUERIES, ORACLES = {}, {}
IDLE, ACTIVE, MOST = 21_600.0, 86_400.0, 50

#: packets with their segment, by a fold over each key's packets
SEGMENTED = A.cte("packets") + f""", o as (select *, row_number() over (partition by k order by seq) as i from packets),
 g as (select k, i, seq, micros, 0::bigint as segment, micros as first, micros as last, 1 as n from o where i = 1
       union all
       select k, i, seq, micros, segment + cut::bigint, case when cut then micros else least(first, micros) end, case when cut then micros else greatest(last, micros) end, case when cut then 1 else n + 1 end
       from (select o.k, o.i, o.seq, o.micros, g.segment, g.first, g.last, g.n, (o.micros - g.first >= {int(ACTIVE * 1e6)} or o.micros - g.last >= {int(IDLE * 1e6)} or g.n >= {MOST}) as cut
             from g join o on o.k = g.k and o.i = g.i + 1)),
 p as (select packets.*, g.segment, first_value(packets.source_ip) over (partition by packets.k, g.segment order by packets.seq) = packets.source_ip as forward from packets join g using (seq))"""
BY = ["source_id", "key", "segment"]
KEY = "k as key"


def query(sql):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def segmented(s, d):
    return W.segment_flows(W.with_flow_key(A.packets_events(s, d)), IDLE, ACTIVE, MOST)


@query(A.cte("packets") + f" select seq, {KEY} from packets")
def prj1_flow_key(s, d):
    return W.with_flow_key(A.packets_events(s, d)).select("seq", "key")


@query(SEGMENTED + f" select {KEY}, segment, min(micros) as first, max(micros) as last, count(*) as packets from p group by k, segment")
def win1_segment_flows(s, d):
    return segmented(s, d).groupBy("key", "segment").agg(F.min("micros").alias("first"), F.max("micros").alias("last"), F.count(F.lit(1)).alias("packets"))


@query(SEGMENTED + f""", e as (select k, segment, min(micros) as first, max(micros) as last, count(*) as n, lead(min(micros)) over (partition by k order by segment) as next_t from p group by k, segment),
 r as (select e.*, (select min(micros) from packets where micros >= least(e.first + {int(ACTIVE * 1e6)}, e.last + {int(IDLE * 1e6)})) as t from e)
 select {KEY}, segment, case when n >= {MOST} and next_t is not null and (t is null or t > next_t) then 'capacity' when t is null then 'capture_end' when t - first >= {int(ACTIVE * 1e6)} then 'active_timeout' else 'idle_timeout' end as reason from r""")
def join15_end_reasons(s, d):
    return W.end_reasons(segmented(s, d), IDLE, ACTIVE, MOST).select("key", "segment", "reason")


@query(SEGMENTED + f""" select {KEY}, segment, count(*) filter (forward) as forward_packets, count(*) filter (not forward) as backward_packets,
 coalesce(sum(network_bytes) filter (forward), 0)::bigint as forward_bytes, coalesce(sum(network_bytes) filter (not forward), 0)::bigint as backward_bytes from p group by k, segment""")
def agg2_direction_counts(s, d):
    return W.direction_counts(segmented(s, d), BY).drop("source_id")


SIDES = {"": "true", "forward_": "forward", "backward_": "not forward"}


@query(SEGMENTED + f" select {KEY}, segment, " + ", ".join(f"count(*) filter (protocol = 'tcp' and tcp_flags & {m} <> 0 and {on}) as {s}{n}_count" for s, on in SIDES.items() for n, m in W.FLAGS.items()) + " from p group by k, segment")
def agg3_tcp_flag_counts(s, d):
    return W.tcp_flag_counts(segmented(s, d), BY).drop("source_id")


@query(SEGMENTED + f""", a as (select k, segment, min(seq) filter (protocol = 'tcp' and forward and tcp_flags & 2 <> 0 and tcp_flags & 16 = 0) as t1 from p group by 1, 2),
 b as (select p.k, p.segment, min(seq) filter (protocol = 'tcp' and not forward and tcp_flags & 2 <> 0 and tcp_flags & 16 <> 0 and seq > t1) as t2 from p join a using (k, segment) group by 1, 2),
 c as (select p.k, p.segment, count(*) filter (protocol = 'tcp' and forward and tcp_flags & 16 <> 0 and seq > t2) > 0 as done, count(*) filter (protocol = 'tcp' and tcp_flags & 4 <> 0) as rst,
       count(*) filter (protocol = 'tcp' and tcp_flags & 2 <> 0) as syn from p join b using (k, segment) group by 1, 2)
 select {KEY}, segment, done::bigint as completed, (rst > 0 or (syn > 0 and not done))::bigint as failed from c""")
def agg4_handshake(s, d):
    return W.handshake(segmented(s, d), BY).drop("source_id")


IAT = SEGMENTED + ", q as (select *, micros - lag(micros) over (partition by k, segment order by micros, seq) as iat, micros - lag(micros) over (partition by k, segment, forward order by micros, seq) as own_iat from p)"


@query(IAT + " select seq, iat, own_iat from q")
def win2_inter_arrival(s, d):
    return W.inter_arrival(segmented(s, d), BY).select("seq", "iat", "own_iat")


@query(SEGMENTED + f", c as (select k, segment, count(*) over (partition by k, segment order by micros range between 1000000 preceding and current row) as c from p) select {KEY}, segment, round(max(c) / count(*), 6) as burst from c group by k, segment")
def win3_burst(s, d):
    return W.burst_score(segmented(s, d), BY).select("key", "segment", F.round("burst", 6).alias("burst"))


#: the features by their definitions; handshake and burst come from the queries above
FEATURE_SQL = """
 count(*) as total_packets, sum(network_bytes)::bigint as total_bytes, count(*) filter (forward) as forward_packets, count(*) filter (not forward) as backward_packets,
 coalesce(sum(network_bytes) filter (forward), 0)::bigint as forward_bytes, coalesce(sum(network_bytes) filter (not forward), 0)::bigint as backward_bytes,
 avg(network_bytes) as mean_packet_size, stddev_pop(network_bytes) as std_packet_size, min(network_bytes)::double as min_packet_size, max(network_bytes)::double as max_packet_size,
 quantile_cont(network_bytes::double, 0.5) as median_packet_size, quantile_cont(network_bytes::double, 0.25) as packet_size_q25, quantile_cont(network_bytes::double, 0.75) as packet_size_q75,
 coalesce(avg(network_bytes) filter (forward), 0) as forward_mean_packet_size, coalesce(avg(network_bytes) filter (not forward), 0) as backward_mean_packet_size, (max(micros) - min(micros)) / 1e6 as flow_duration,
 coalesce(avg(iat / 1e6), 0) as mean_inter_arrival_time, coalesce(stddev_pop(iat / 1e6), 0) as std_inter_arrival_time, coalesce(min(iat / 1e6), 0) as min_inter_arrival_time, coalesce(max(iat / 1e6), 0) as max_inter_arrival_time,
 coalesce(quantile_cont(iat / 1e6, 0.5), 0) as median_inter_arrival_time, coalesce(quantile_cont(iat / 1e6, 0.25), 0) as iat_q25, coalesce(quantile_cont(iat / 1e6, 0.75), 0) as iat_q75,
 coalesce(avg(own_iat / 1e6) filter (forward), 0) as forward_mean_iat, coalesce(avg(own_iat / 1e6) filter (not forward), 0) as backward_mean_iat, count(iat) as iats, """ + ", ".join(f"count(*) filter (protocol = 'tcp' and tcp_flags & {m} <> 0) as {n}_count" for n, m in W.FLAGS.items())
RATIO_SQL = """
 case when flow_duration = 0 then 0 else total_packets / flow_duration end as packets_per_second, case when flow_duration = 0 then 0 else total_bytes / flow_duration end as bytes_per_second,
 case when backward_packets = 0 then 0 else forward_packets / backward_packets end as forward_backward_packet_ratio, case when backward_bytes = 0 then 0 else forward_bytes / backward_bytes end as forward_backward_byte_ratio,
 syn_count / total_packets as syn_ratio, rst_count / total_packets as rst_ratio, ack_count / total_packets as ack_ratio, case when total_bytes = 0 then 0 else abs(forward_bytes - backward_bytes) / total_bytes end as asymmetry_score,
 case when iats < 3 or mean_inter_arrival_time <= 0 then 0 else 1 / (1 + std_inter_arrival_time / mean_inter_arrival_time) end as periodicity_score"""
HAND_SQL = """, t1_ as (select k, segment, min(seq) filter (protocol = 'tcp' and forward and tcp_flags & 2 <> 0 and tcp_flags & 16 = 0) as t1 from p group by 1, 2),
 t2_ as (select p.k, p.segment, min(seq) filter (protocol = 'tcp' and not forward and tcp_flags & 2 <> 0 and tcp_flags & 16 <> 0 and seq > t1) as t2 from p join t1_ using (k, segment) group by 1, 2),
 hand as (select p.k, p.segment, count(*) filter (protocol = 'tcp' and forward and tcp_flags & 16 <> 0 and seq > t2) > 0 as done, count(*) filter (protocol = 'tcp' and tcp_flags & 4 <> 0) as rst,
       count(*) filter (protocol = 'tcp' and tcp_flags & 2 <> 0) as syn from p join t2_ using (k, segment) group by 1, 2),
 near_ as (select k, segment, count(*) over (partition by k, segment order by micros range between 1000000 preceding and current row) as c from p), burst as (select k, segment, max(c) / count(*) as connection_burst_score from near_ group by 1, 2)"""
TIMES = ("flow_duration", "mean_inter_arrival_time", "std_inter_arrival_time", "min_inter_arrival_time", "max_inter_arrival_time", "median_inter_arrival_time", "iat_q25", "iat_q75", "forward_mean_iat", "backward_mean_iat")
#: times in days, as the table's packets are hours apart
SHOWN = [(n, 86400 if n in TIMES else 1) for n in W.FEATURES]


#: all features of each segment
WHOLE = IAT + HAND_SQL + f""", f as (select k, segment, {FEATURE_SQL} from q group by k, segment),
 whole as (select f.*, {RATIO_SQL}, connection_burst_score, done::bigint as completed_handshake_indicator, (rst > 0 or (syn > 0 and not done))::bigint as failed_connection_indicator from f join hand using (k, segment) join burst using (k, segment))"""


@query(WHOLE + f""" select {KEY}, segment, {", ".join(f"round({n} / {by}, 5) as {n}" for n, by in SHOWN)} from whole""")
def agg1_flow_features(s, d):
    f = W.flow_features(segmented(s, d), BY)
    return f.select("key", "segment", *[F.round(F.col(n) / by, 5).alias(n) for n, by in SHOWN])


@query(IAT + f""", f as (select k, segment, count(iat) as n, avg(iat / 1e6) as m, stddev_pop(iat / 1e6) as sd from q group by k, segment)
 select {KEY}, segment, round(case when n < 3 or m <= 0 then 0.0 else 1 / (1 + sd / m) end, 5) as periodicity from f""")
def win4_periodicity(s, d):
    return W.flow_features(segmented(s, d), BY).select("key", "segment", F.round("periodicity_score", 5).alias("periodicity"))


@query(A.cte("packets") + """, q as (select seq, coalesce((micros - lag(micros) over (order by seq)) / 1e6, 0) as delta from packets)
 select seq, round(delta, 6) as delta, delta < 0 as out_of_order, least(greatest(delta, 0) / 60, 5) as delay, greatest(delta, 0) / 60 > 5 as capped from q""")
def win6_replay_gaps(s, d):
    return W.replay_gaps(A.packets_events(s, d), 60.0, 5.0).select("seq", F.round("delta", 6).alias("delta"), "out_of_order", "delay", "capped")


@query(SEGMENTED + """, e as (select min(micros) as first, max(micros) as last from p group by k, segment), v as (select first as t, 1 as d from e union all select last, -1 from e)
 select 'cap-0' as source_id, max(o)::bigint as peak from (select sum(d) over (order by t, d desc rows unbounded preceding) as o from v)""")
def win7_active_peak(s, d):
    return W.active_peak(segmented(s, d).groupBy(*BY).agg(F.min("micros").alias("first"), F.max("micros").alias("last")))


@query(SEGMENTED + " select 'cap-0' as source_id, count(*) as packets, round((max(micros) - min(micros)) / 1e6, 6) as seconds, count(distinct (k, segment)) as flows from p")
def agg33_capture_profile(s, d):
    x = segmented(s, d)
    return W.capture_profile(x, x.select(*BY).distinct()).withColumn("seconds", F.round("seconds", 6))
