"""The star-schema, event and document tables as packets, flows, scores, alerts and dataset rows.

``SQL`` has the same as DuckDB common table expressions, by name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packets_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    client, server = F.concat(F.lit("10.0.0."), F.col("user_id") % 50), F.concat(F.lit("198.51.100."), F.col("user_id") % 5)
    back = F.col("event_id") % 3 == 0
    return e.select(
        F.lit("cap-0").alias("source_id"),
        F.col("event_id").alias("seq"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"),
        F.lit(4).alias("ip_version"),
        F.when(back, server).otherwise(client).alias("source_ip"),
        F.when(back, client).otherwise(server).alias("destination_ip"),
        F.when(back, 443).otherwise(40000).alias("source_port"),
        F.when(back, 40000).otherwise(443).alias("destination_port"),
        F.when(F.col("event_type") == "view", "udp").otherwise("tcp").alias("protocol"),
        F.when(F.col("event_type") == "view", 17).otherwise(6).alias("protocol_number"),
        (40 + F.floor(F.col("value") * 10)).cast("long").alias("network_bytes"),
        (F.get_json_object("props", "$.k").cast("long") % 64).alias("tcp_flags"),
    )


def flows_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("packets"), F.sum((40 + F.col("l_quantity") * 10).cast("long")).alias("bytes"))
    k = F.col("o_orderkey")
    return orders.join(lines, k == F.col("l_orderkey"), "left").select(
        k.alias("flow_id"),
        (F.col("o_custkey") % 7).alias("source_id"),
        F.concat(F.lit("10.0.0."), F.col("o_custkey") % 40).alias("source_ip"),
        F.concat(F.lit("198.51.100."), k % 11).alias("destination_ip"),
        F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("first_seen"),
        (F.unix_micros(F.col("o_orderdate").cast("timestamp")) + (k % 4) * F.lit(86_400_000_000)).alias("last_seen"),
        F.element_at(F.array(F.lit("tcp"), F.lit("udp"), F.lit("icmp")), (k % 3 + 1).cast("int")).alias("protocol"),
        F.coalesce("packets", F.lit(0)).cast("long").alias("packets"),
        F.coalesce("bytes", F.lit(0)).cast("long").alias("bytes"),
        F.when(F.col("o_orderstatus") == "F", "malicious").otherwise("benign").alias("label"),
    )


def detections_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    return o.select(k.alias("flow_id"), (F.col("o_totalprice") / 500000).alias("supervised"), (((k * 7919) % 1000) / 1000).alias("anomaly"), (F.col("o_orderstatus") == "F").cast("long").alias("label"), (F.col("o_custkey") % 5).alias("job_id"))


def scores_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    year = F.year("l_shipdate")
    return table(spark, sf_dir, "lineitem").select(
        (F.round(F.col("l_discount") * 10, 6) + 0.0).alias("p"),
        (F.round(F.col("l_tax") * 12.5, 6) + 0.0).alias("a"),
        (F.col("l_returnflag") == "R").cast("long").alias("label"),
        F.concat("l_returnflag", "l_linestatus").alias("family"),
        F.col("l_suppkey").alias("group_id"),
        F.when(year <= 1995, "early").when(year <= 1998, "middle").otherwise("late").alias("stage"),
    )


REASONS = {"1-URGENT": "AUTH_FAILURE", "2-HIGH": "HIGH_RESET_RATIO", "3-MEDIUM": "OUTBOUND_VOLUME", "4-NOT SPECIFIED": "LOW_IAT_VARIANCE", "5-LOW": "RISK_SCORE_ABOVE_ALERT_THRESHOLD"}


def alerts_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k = table(spark, sf_dir, "orders").where("o_totalprice > 450000"), F.col("o_orderkey")
    reason = F.coalesce(*[F.when(F.col("o_orderpriority") == p, r) for p, r in REASONS.items()])
    start = F.unix_micros(F.col("o_orderdate").cast("timestamp"))
    return o.select(
        k.alias("alert_id"),
        F.concat(F.lit("10.0.0."), F.col("o_custkey") % 60).alias("source_ip"),
        F.concat(F.lit("198.51.100."), k % 5).alias("destination_ip"),
        start.alias("event_start"),
        (start + (k % 3) * F.lit(86_400_000_000)).alias("event_end"),
        (F.col("o_totalprice") / 500000).alias("risk"),
        F.when(k % 4 == 0, "multi_engine_suspicion").otherwise("behavioral_pattern").alias("alert_type"),
        reason.alias("reason"),
        F.when(F.col("o_orderstatus") == "F", "true_positive").when(F.col("o_orderstatus") == "P", "false_positive").alias("verdict"),
    )


FEATURES = ("quantity", "price", "discount", "tax", "line")


def dataset_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("record_id"),
        F.col("l_suppkey").alias("group_id"),
        F.concat(F.lit("f"), "l_suppkey").alias("source_file"),
        F.to_date("l_shipdate").alias("observed_on"),
        F.col("l_returnflag").alias("original_label"),
        (F.col("l_returnflag") == "R").cast("long").alias("label"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("price"),
        (F.col("l_discount") + 0.0).alias("discount"),
        (F.col("l_tax") + 0.0).alias("tax"),
        F.col("l_linenumber").cast("double").alias("line"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("features"), (F.col("label") < 5).alias("benign"))


_REASON = " ".join(f"when '{p}' then '{r}'" for p, r in REASONS.items())
SQL = {
    "packets": """
        select 'cap-0' as source_id, event_id as seq, epoch_us(ts) as micros,
               case when event_id % 3 = 0 then '198.51.100.' || (user_id % 5) else '10.0.0.' || (user_id % 50) end as source_ip,
               case when event_id % 3 = 0 then '10.0.0.' || (user_id % 50) else '198.51.100.' || (user_id % 5) end as destination_ip,
               '4|' || case when event_type = 'view' then 17 else 6 end || '|10.0.0.' || (user_id % 50) || ':40000>198.51.100.' || (user_id % 5) || ':443|ports' as k,
               event_id % 3 = 0 as back, case when event_type = 'view' then 'udp' else 'tcp' end as protocol,
               (40 + floor(value * 10))::bigint as network_bytes, (json_extract_string(props, '$.k')::bigint % 64) as tcp_flags
        from events""",
    "flows": """
        select o_orderkey as flow_id, o_custkey % 7 as source_id, '10.0.0.' || (o_custkey % 40) as source_ip, '198.51.100.' || (o_orderkey % 11) as destination_ip,
               epoch_us(o_orderdate) as first_seen, epoch_us(o_orderdate) + (o_orderkey % 4) * 86400000000 as last_seen,
               ['tcp', 'udp', 'icmp'][o_orderkey % 3 + 1] as protocol, coalesce(packets, 0)::bigint as packets, coalesce(bytes, 0)::bigint as bytes,
               case when o_orderstatus = 'F' then 'malicious' else 'benign' end as label
        from orders left join (select l_orderkey, count(*) as packets, sum(trunc(40 + l_quantity * 10)::bigint) as bytes from lineitem group by 1) on l_orderkey = o_orderkey""",
    "detections": """
        select o_orderkey as flow_id, o_totalprice / 500000 as supervised, ((o_orderkey * 7919) % 1000) / 1000 as anomaly, (o_orderstatus = 'F')::bigint as label, o_custkey % 5 as job_id from orders""",
    "scores": """
        select round(l_discount * 10, 6) + 0.0 as p, round(l_tax * 12.5, 6) + 0.0 as a, (l_returnflag = 'R')::bigint as label, l_returnflag || l_linestatus as family, l_suppkey as group_id,
               case when year(l_shipdate) <= 1995 then 'early' when year(l_shipdate) <= 1998 then 'middle' else 'late' end as stage from lineitem""",
    "alerts": f"""
        select o_orderkey as alert_id, '10.0.0.' || (o_custkey % 60) as source_ip, '198.51.100.' || (o_orderkey % 5) as destination_ip, epoch_us(o_orderdate) as event_start,
               epoch_us(o_orderdate) + (o_orderkey % 3) * 86400000000 as event_end, o_totalprice / 500000 as risk,
               case when o_orderkey % 4 = 0 then 'multi_engine_suspicion' else 'behavioral_pattern' end as alert_type, case o_orderpriority {_REASON} end as reason,
               case o_orderstatus when 'F' then 'true_positive' when 'P' then 'false_positive' end as verdict
        from orders where o_totalprice > 450000""",
    "rows_": """
        select l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey as record_id, l_suppkey as group_id, 'f' || l_suppkey as source_file, l_shipdate::date as observed_on,
               l_returnflag as original_label, (l_returnflag = 'R')::bigint as label, l_quantity as quantity, l_extendedprice as price, l_discount + 0.0 as discount, l_tax + 0.0 as tax, l_linenumber::double as line from lineitem""",
    "vecs": "select vec_id, embedding::double[] as features, label < 5 as benign from embeddings",
}


def cte(*names: str) -> str:
    """A WITH clause (recursive, so that folds may follow) of the named adapters."""
    return "with recursive " + ", ".join(f"{n} as ({SQL[n]})" for n in names)


def in_order(*columns: str) -> Window:
    return Window.orderBy(*columns)
