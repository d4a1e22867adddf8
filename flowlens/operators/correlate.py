"""Alerts to groups by entity and event-time window, and groups to hypotheses."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.functions.scalars import casefold_trim, clamp01, normalize_ip
from flowlens.operators.detect import GROUP_BANDS, severity_band

FAILURE_TOKENS = ("fail", "denied", "reject", "reset", "rst", "auth")


def eligible_alerts(alerts: DataFrame, excluded: Sequence[str] = ("false_positive", "benign_expected")) -> DataFrame:
    """Alerts whose verdict (null: unreviewed) isn't excluded."""
    return alerts.withColumn("verdict", F.coalesce("verdict", F.lit("unreviewed"))).where(~F.col("verdict").isin(*excluded))


def verdict_violations(alerts: DataFrame, known: Sequence[str] = ("unreviewed", "true_positive", "needs_more_information", "false_positive", "benign_expected")) -> DataFrame:
    """(alert_id, rule): ids that occur more than once, and verdicts that are neither included nor excluded."""
    many = alerts.groupBy("alert_id").count().where("count > 1").select("alert_id", F.lit("duplicate_id").alias("rule"))
    return many.unionByName(alerts.where(~F.coalesce("verdict", F.lit("unreviewed")).isin(*known)).select("alert_id", F.lit("unknown_verdict").alias("rule")))


#: kinds of entities in order, and those whose values are case-folded
ADDRESSES = ("source_ip", "destination_ip")
FOLDED = ("source_host", "destination_host", "user", "protocol", "service")
KEPT = ("flow_id", "capture_session_id")
MOST_ENTITIES = 32


def observed_entities(alerts: DataFrame) -> DataFrame:
    """(alert_id, entity): the known kinds among the alerts' columns as kind:value, and the pair of source and destination.

    Values are trimmed, addresses put into their shortest form, hosts, users, protocols and services case-folded; empty
    ones are left out, and at most MOST_ENTITIES of an alert stay, by kind. Columns that alerts lack count as null.
    """
    alerts = alerts.withColumns({f"_{k}": normalize_ip(F.trim(k)) for k in ADDRESSES})
    value = {k: F.col(f"_{k}") for k in ADDRESSES} | {k: casefold_trim(F.col(k)) for k in FOLDED if k in alerts.columns} | {k: F.trim(F.col(k).cast("string")) for k in KEPT if k in alerts.columns}
    each = [F.when(v != "", F.concat(F.lit(f"{k}:"), v)) for k, v in value.items()]
    each.append(F.concat(F.lit("pair:"), value["source_ip"], F.lit("->"), value["destination_ip"]))
    return alerts.select("alert_id", F.explode(F.slice(F.array_compact(F.array(*each)), 1, MOST_ENTITIES)).alias("entity")).distinct()


def anchored_windows(members: DataFrame, seconds: float, least: int = 2) -> DataFrame:
    """(entity, cluster, alert_id) of members (entity, alert_id, event_start, event_end).

    In the order of start and id, an anchor takes the run of alerts that end within the window from its start, up to
    the first that doesn't fit, which is the next anchor. Runs of fewer than ``least`` are dropped. An entity is
    folded whole: the window's rule needs its alerts in order.
    """
    span = round(seconds * 1e6)

    def f(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["event_start", "alert_id"])
        cluster, limit, out = -1, None, []
        for start, end in zip(rows.event_start.tolist(), rows.event_end.tolist(), strict=True):
            if limit is None or end > limit:
                cluster, limit = cluster + 1, start + span
            out.append(cluster)
        rows = rows.assign(cluster=out)
        size = rows.groupby("cluster").alert_id.transform("size")
        return rows.loc[size >= least, ["entity", "cluster", "alert_id"]]

    kind = members.schema["alert_id"].dataType.simpleString()
    return members.groupBy("entity").applyInPandas(f, f"entity string, cluster long, alert_id {kind}")


def regularity(clusters: DataFrame) -> DataFrame:
    """(entity, cluster, regularity): 1 - (longest - shortest) / mean of the intervals between starts; null below two intervals or at mean 0."""
    w = Window.partitionBy("entity", "cluster").orderBy("event_start", "alert_id")
    gaps = clusters.withColumn("gap", (F.col("event_start") - F.lag("event_start").over(w)) / 1e6)
    out = gaps.groupBy("entity", "cluster").agg(F.count("gap").alias("n"), F.avg("gap").alias("m"), F.max("gap").alias("hi"), F.min("gap").alias("lo"))
    return out.select("entity", "cluster", F.when((F.col("n") >= 2) & (F.col("m") > 0), 1 - (F.col("hi") - F.col("lo")) / F.col("m")).alias("regularity"))


def matched_rules(clusters: DataFrame, regular: float = 0.8) -> DataFrame:
    """(entity, cluster, rules) with rules sorted; clusters carry the alerts' columns."""
    fails = F.exists(F.array(*[F.lit(t) for t in FAILURE_TOKENS]), lambda t: F.lower("reason").contains(t))
    facts = clusters.groupBy("entity", "cluster").agg(
        F.count_distinct("source_ip").alias("sources"), F.count_distinct("destination_ip").alias("destinations"), F.bool_or(fails).alias("fails"),
        F.bool_or(F.col("alert_type") == "multi_engine_suspicion").alias("multi"), F.count_distinct("reason").alias("reasons"),
    ).join(regularity(clusters), ["entity", "cluster"])
    one_source = (F.col("sources") == 1) & (F.col("destinations") >= 2)
    rules = {
        "destination_fan_in": (F.col("destinations") == 1) & (F.col("sources") >= 2),
        "multi_alert_accumulation": F.col("reasons") >= 1,
        "multi_engine_evidence": F.col("multi"),
        "periodic_beacon_like_activity": F.col("regularity") >= regular,
        "repeated_source_destination_failures": F.col("entity").startswith("pair:") & F.col("fails"),
        "source_centered_reconnaissance": one_source,
        "source_fan_out": one_source,
    }
    return facts.select("entity", "cluster", F.array_compact(F.array(*[F.when(c, F.lit(r)) for r, c in rules.items()])).alias("rules"))


def group_score(risk: Column, alerts: Column, reasons: Column, rules: Column, seconds: Column, window: float) -> Column:
    """.35 risk + .20 count / 5 + .25 (reasons + rules) / 6 + .20 closeness, each within [0, 1]."""
    return clamp01(risk) * 0.35 + clamp01(alerts / 5) * 0.20 + clamp01((reasons + rules) / 6) * 0.25 + clamp01(1 - seconds / window) * 0.20


def set_digest(members: Column) -> Column:
    return F.sha2(F.to_json(F.struct(members.alias("members"))), 256)


def ruled_clusters(members: DataFrame, alerts: DataFrame, seconds: float) -> DataFrame:
    """(entity, cluster, members, rules) of members (entity, alert_id, event_start, event_end); members are sorted ids as text."""
    found = anchored_windows(members, seconds)
    sets = found.groupBy("entity", "cluster").agg(F.array_sort(F.collect_set(F.col("alert_id").cast("string"))).alias("members"))
    return sets.join(matched_rules(found.join(alerts, "alert_id")), ["entity", "cluster"])


def merged_groups(clusters: DataFrame, alerts: DataFrame, seconds: float, least_score: float = 0.35) -> DataFrame:
    """A group for each set of members among clusters: the union of its clusters' entities and rules, its alerts' facts, score and severity.

    Sets are told apart by their digests, so that a row for each member doesn't carry the whole set.
    """
    clusters = clusters.withColumn("_set", set_digest(F.col("members")))
    merged = clusters.groupBy("_set").agg(F.first("members").alias("members"), F.array_sort(F.collect_set("entity")).alias("entities"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("rules")))).alias("rules"))
    ids = clusters.groupBy("_set").agg(F.first("members").alias("members")).select("_set", F.explode("members").alias("_id"))
    each = ids.join(alerts.withColumn("_id", F.col("alert_id").cast("string")), "_id")
    facts = each.groupBy("_set").agg(
        F.count(F.lit(1)).alias("alerts"), F.avg("risk").alias("risk"), F.count_distinct("reason").alias("reasons"), F.array_sort(F.collect_set("reason")).alias("codes"), F.min("event_start").alias("first_seen"), F.max("event_end").alias("last_seen"),
    )
    out = merged.join(facts, "_set").drop("_set")
    score = group_score(F.col("risk"), F.col("alerts"), F.col("reasons"), F.size("rules"), (F.col("last_seen") - F.col("first_seen")) / 1e6, seconds)
    return out.withColumn("score", F.round(score, 6)).where(F.col("score") >= least_score).withColumn("severity", severity_band(F.col("score"), GROUP_BANDS))


def alert_groups(alerts: DataFrame, seconds: float, least_score: float = 0.35) -> DataFrame:
    """Groups of eligible alerts: clusters of equal members under several entities are one group with the union of rules and entities."""
    use = eligible_alerts(alerts)
    members = observed_entities(use).join(use.select("alert_id", "event_start", "event_end"), "alert_id")
    return merged_groups(ruled_clusters(members, use, seconds), use, seconds, least_score)


#: templates from the first priority: rules that all are there, rules of which one is, tokens of which a reason holds one
TEMPLATES = (
    ("possible_command_and_control_pattern", ("periodic_beacon_like_activity", "multi_engine_evidence"), (), ()),
    ("possible_data_exfiltration_pattern", (), (), ("exfil", "outbound")),
    ("possible_credential_abuse", (), (), ("auth", "credential", "account")),
    ("possible_brute_force_activity", ("repeated_source_destination_failures",), (), ()),
    ("possible_network_reconnaissance", (), ("source_centered_reconnaissance", "source_fan_out"), ()),
    ("possible_denial_of_service_behavior", ("destination_fan_in",), (), ()),
    ("possible_beaconing_behavior", ("periodic_beacon_like_activity",), (), ()),
)
UNCLASSIFIED = "unclassified_behavioral_anomaly"


def candidate_templates(rules: Column, codes: Column) -> Column:
    """The templates that rules and reason codes call for, by priority; the unclassified one where none does."""
    held = lambda every, some, tokens: [
        *([F.forall(F.array(*map(F.lit, every)), lambda r: F.array_contains(rules, r))] if every else []),
        *([F.arrays_overlap(rules, F.array(*map(F.lit, some)))] if some else []),
        *([F.exists(codes, lambda c: F.lower(c).rlike("|".join(tokens)))] if tokens else []),
    ][0]
    found = F.array_compact(F.array(*[F.when(held(*how), F.lit(name)) for name, *how in TEMPLATES]))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(UNCLASSIFIED)))


def hypotheses(groups: DataFrame, least: float = 0.5) -> DataFrame:
    """A hypothesis for each group of at least two alerts, with rules and a score of at least ``least``: primary template, number of candidates, confidence."""
    g = groups.where((F.col("alerts") >= 2) & (F.col("score") >= least) & (F.size("rules") > 0))
    g = g.withColumn("candidates", candidate_templates(F.col("rules"), F.col("codes"))).withColumn("n", F.size("candidates"))
    sure = 0.40 * F.col("score") + 0.25 * F.greatest(F.lit(0.2), 1 - 0.15 * (F.col("n") - 1)) + 0.20 * F.least(F.lit(1.0), F.size("rules") / 4) + 0.15 * F.when(F.size("entities") > 0, 1.0).otherwise(0.0)
    return g.select("members", F.get("candidates", 0).alias("template"), F.col("n").cast("long").alias("candidates"), F.round(clamp01(sure), 6).alias("confidence"))
