"""Scores to detections and alerts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: severity and its inclusive lower bound, from the highest
BANDS = (("critical", 0.9), ("high", 0.7), ("medium", 0.4), ("low", 0.2), ("informational", 0.0))
#: the same for groups of alerts
GROUP_BANDS = (("critical", 0.9), ("high", 0.7), ("medium", 0.5), ("low", 0.35), ("informational", 0.0))


def severity_band(score: Column, bands: Sequence[tuple[str, float]] = BANDS) -> Column:
    """The highest band whose lower bound the score reaches; null below all."""
    return F.coalesce(*[F.when(score >= low, name) for name, low in sorted(bands, key=lambda b: -b[1])])


def map_risk(detections: DataFrame, source: str = "fusion", threshold: float = 0.5) -> DataFrame:
    return detections.withColumn("risk", F.col(source)).withColumn("alert_required", F.col(source) >= threshold)


def alert_type(supervised: Column, anomaly: Column, supervised_at: float, anomaly_at: float) -> Column:
    s, a = supervised >= supervised_at, anomaly >= anomaly_at
    return F.when(s & a, "multi_engine_suspicion").when(s, "supervised_detection").when(a, "anomaly_detection").otherwise("behavioral_pattern")


def score_violations(detections: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(flow_id, column) of scores that are null, not finite or outside [0, 1]."""
    bad = lambda c: F.col(c).isNull() | F.isnan(c) | ~F.col(c).between(0, 1)
    found = F.array_compact(F.array(*[F.when(bad(c), F.lit(c)) for c in columns]))
    return detections.select("flow_id", F.explode(found).alias("column"))


#: the catalogue in order: reason code, feature, and the side of the benign profile's q95 or q05 on which it is raised
CATALOGUE = (
    ("ABNORMALLY_HIGH_PACKET_RATE", "packets_per_second", "above"),
    ("LOW_IAT_VARIANCE", "std_inter_arrival_time", "below"),
    ("PERIODIC_BEACONING_PATTERN", "periodicity_score", "above"),
    ("HIGH_SYN_RATIO", "syn_ratio", "above"),
    ("HIGH_RESET_RATIO", "rst_ratio", "above"),
    ("STRONG_TRAFFIC_ASYMMETRY", "asymmetry_score", "above"),
    ("SHORT_CONNECTION_BURST", "connection_burst_score", "above"),
)


def reason_codes(flows: DataFrame, profile: DataFrame, supervised_at: float, anomaly_at: float, risk_at: float) -> DataFrame:
    """flows with codes, in catalogue order; profile is (feature, q05, q95), a row for each feature of the catalogue.

    A low deviation of times counts only where packets are apart at all. Scores give the codes of the engines, of both
    together and of the risk.
    """
    bound = {r["feature"]: r for r in profile.where(F.col("feature").isin([c for _, c, _ in CATALOGUE])).select("feature", "q05", "q95").collect()}
    codes = []
    for code, c, side in CATALOGUE:
        if c in bound:
            raised = F.col(c) > float(bound[c]["q95"]) if side == "above" else (F.col(c) < float(bound[c]["q05"])) & (F.col("mean_inter_arrival_time") > 0)
            codes.append(F.when(raised, F.lit(code)))
    s, a = F.col("supervised") >= supervised_at, F.col("anomaly") >= anomaly_at
    codes += [F.when(s, F.lit("SUPERVISED_HIGH_CONFIDENCE")), F.when(a, F.lit("ANOMALY_HIGH_SCORE")), F.when(s & a, F.lit("MULTI_ENGINE_SUPPORT")), F.when(F.col("risk") >= risk_at, F.lit("RISK_SCORE_ABOVE_ALERT_THRESHOLD"))]
    return flows.withColumn("codes", F.array_compact(F.array(*codes)))


def build_alerts(detections: DataFrame, flows: DataFrame) -> DataFrame:
    """An alert for each detection that requires one: type, severity, entities and the facts of its flow."""
    joined = detections.where("alert_required").join(flows.drop("label"), "flow_id")
    entities = F.array(F.concat(F.lit("source_ip:"), "source_ip"), F.concat(F.lit("destination_ip:"), "destination_ip"), F.concat(F.lit("flow:"), F.col("flow_id").cast("string")))
    return joined.select(F.col("flow_id").alias("alert_id"), alert_type(F.col("supervised"), F.col("anomaly"), 0.5, 0.6).alias("alert_type"), severity_band(F.col("risk")).alias("severity"), "risk", entities.alias("entities"), F.struct("protocol", "first_seen", "last_seen").alias("evidence"))
