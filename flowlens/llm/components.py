"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import dropped, written


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component_id) for every id in links: the smallest id that it reaches, itself included.

    Each round takes the smallest label among the neighbours and then the label of that label, so that
    long chains need about log(length) rounds. Rounds are written to the shared folder. Hubs meet in a
    partially aggregated minimum and in joins that adaptive execution can split. Null ends and loops are
    ignored; an empty table gives an empty result.
    """
    pairs = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    edges = written(pairs.union(pairs.select("v", "u")).distinct(), "edges")
    labels = written(edges.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("m")).select("id", F.least("id", "m").alias("label")), "labels")
    while True:
        labels_now = labels.select("id", "label")
        near = edges.join(labels_now, edges.v == labels_now.id).groupBy("u").agg(F.min("label").alias("m"))
        low = labels_now.join(near, labels_now.id == near.u).select("id", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        low = written(low, "low")
        far = low.select(F.col("id").alias("via"), F.col("label").alias("far"))
        after = written(low.join(far, low.label == far.via).select("id", "old", F.least("label", "far").alias("label")), "labels")
        dropped(labels, low)
        if after.where("label <> old").isEmpty():
            dropped(edges)
            return after.select("id", F.col("label").alias("component_id"))
        labels = after
