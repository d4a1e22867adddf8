"""Times the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "win1_segment_flows", "agg1_flow_features", "join15_end_reasons", "flt1_filter_flows", "agg5_flow_summary", "srt3_top_risky_flows", "agg8_feature_statistics", "agg13_label_leakage", "join8_near_pairs",
    "agg17_confusion_metrics", "agg18_curve_areas", "ml14_select_fusion", "cor4_alert_groups", "hyp4_hypotheses", "fbk1_retraining_candidates",
)

#: timed for their rates only, so that totals stay comparable: query, table that it goes over, what is counted
RATED = {"ml13_fuse": ("orders", "pairs_fused_per_sec"), "ml7_isolation_forest": ("lineitem", "rows_fitted_and_anomaly_scored_per_sec")}


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from flowlens.queries import QUERIES

    spark.read.parquet(f"{sf}/lineitem.parquet").count()
    took = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
    packets = spark.read.parquet(f"{sf}/events.parquet").count()
    rates = {"packets_per_sec_segments_and_features": round(packets / took["agg1_flow_features"]), "orders_per_sec_to_alert_groups": round(spark.read.parquet(f"{sf}/orders.parquet").count() / took["cor4_alert_groups"])}
    for name, (table, what) in RATED.items():
        start = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        rates[what] = round(spark.read.parquet(f"{sf}/{table}.parquet").count() / (time.perf_counter() - start))
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf.rsplit("sf", 1)[-1], **rates}))


if __name__ == "__main__":
    main()
