"""Queries of snapshots, the frozen gate and leakage."""

from pyspark.sql import functions as F

from flowlens import adapters as A
from flowlens.operators import evidence as V
from flowlens.plans.dataset import FEATURES, SPLIT, split_rows

QUERIES, ORACLES = {}, {}


def query(sql):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_SNAP = """'{"alert_id":' || alert_id || ',"alert_type":"' || alert_type || '","event_start":' || event_start || ',"reason":"' || reason || '","verdict":' || case when verdict is null then 'null' else '"' || verdict || '"' end || '}'"""
_FLOW = """'{"bytes":' || bytes || ',"flow_id":' || flow_id || ',"packets":' || packets || ',"protocol":"' || protocol || '","source_ip":"' || source_ip || '"}'"""


@query(A.cte("alerts", "flows") + f""", obj as (select 'security_alert' as object_type, alert_id::varchar as object_id, {_SNAP} as snapshot from alerts union all select 'network_flow', flow_id::varchar, {_FLOW} from flows),
 refs as (select case when o_orderkey % 3 = 0 then 'security_alert' when o_orderkey % 3 = 1 then 'network_flow' else 'weather' end as object_type, o_orderkey::varchar as object_id from orders)
 select object_type, object_id, case when object_type = 'weather' then 'unknown_type' when snapshot is null then 'missing' else 'resolved' end as status, sha256(snapshot) as checksum from refs left join obj using (object_type, object_id)""")
def join13_evidence(s, d):
    k = F.col("o_orderkey")
    refs = A.table(s, d, "orders").select(F.when(k % 3 == 0, "security_alert").when(k % 3 == 1, "network_flow").otherwise("weather").alias("object_type"), k.alias("object_id"))
    tables = {"security_alert": (A.alerts_orders(s, d).select("alert_id", "alert_type", "event_start", "reason", "verdict"), "alert_id"), "network_flow": (A.flows_orders(s, d).select("flow_id", "bytes", "packets", "protocol", "source_ip", "label"), "flow_id")}
    return V.resolve_evidence(refs, tables).select("object_type", "object_id", "status", "checksum")


KEPT = ["record_id", "source_file", "original_label", "label"]
_TEXT = " || ',' || ".join(f"length({c}::varchar) || ':' || {c}::varchar" for c in KEPT)
INVENTORY = SPLIT + f""", inv as (select split, count(*) as n, count(distinct group_id) as groups, sum(label)::bigint as attacks, sum(('0x' || substr(sha256({_TEXT}), 1, 13))::bigint)::varchar as digest from asg group by 1)"""


@query(INVENTORY + " select * from inv")
def ml18_split_inventory(s, d):
    return V.split_inventory(split_rows(s, d), "split", "group_id", "label", KEPT)


@query(INVENTORY + """, lost as (select min(record_id) as r from asg where split = 'test'), cut as (select * from asg, lost where not (split = 'test' and record_id = r)),
 b as (select count(*) as n, count(distinct group_id) as groups, sum(label)::bigint as attacks from cut where split = 'test')
 select 'test' as split, unnest(list_filter(['n_differ', 'digest_differ', case when b.groups <> inv.groups then 'groups_differ' end, case when b.attacks <> inv.attacks then 'attacks_differ' end], lambda x: x is not null)) as rule from b, inv where inv.split = 'test'""")
def ml18_frozen_gate(s, d):
    """Against the inventory of the same rows and one more test row, which is named by what differs."""
    rows = split_rows(s, d)
    frozen = V.split_inventory(rows, "split", "group_id", "label", KEPT)
    first = rows.where("split = 'test'").agg(F.min("record_id").alias("first"))
    cut = rows.crossJoin(F.broadcast(first)).where("not (split = 'test' and record_id = first)").drop("first")
    return V.gate_violations(cut, "split", "group_id", "label", KEPT, frozen)


@query(SPLIT + """, fo as (select *, 'f-' || case when group_id % 10 = 3 then 'Bot' else '' end || group_id as file from asg), lk as (
  select 'group_overlap' as finding, observed_on::varchar as value from asg group by 2 having count(distinct split) > 1
  union all select 'source_file_overlap', source_file from asg group by 2 having count(distinct split) > 1
  union all select 'filename_leakage', file from fo where file like '%Bot%' group by 2
  union all select 'timestamp_warning', observed_on::varchar from asg group by 2 having count(distinct label) = 1 and (select count(distinct observed_on) from asg) > 1)
 select finding, value, finding not like '%warning' as blocker from lk""")
def agg14_leakage_report(s, d):
    """The findings that have values on these rows: groups are days here, so that they leak; identical vectors are left to agg12_fingerprint_overlap."""
    rows = split_rows(s, d).withColumn("file", F.concat(F.lit("f-"), F.when(F.col("group_id") % 10 == 3, "Bot").otherwise(""), F.col("group_id").cast("string")))
    out = V.leakage_report(rows, FEATURES, columns={"group_id": "observed_on", "source_file": "file", "record_id": "record_id", "observed_at": "observed_on"})
    return out.where("finding <> 'exact_duplicate_overlap'")
