"""Packets to flows: canonical keys, timeout segmentation with reasons, features."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.functions.scalars import packed_address, safe_ratio

FLAGS = {"fin": 1, "syn": 2, "rst": 4, "psh": 8, "ack": 16, "urg": 32}


#: ICMP types of an echo and its reply, version 4 and 6
ECHO = (0, 8, 128, 129)


def with_flow_key(packets: DataFrame) -> DataFrame:
    """key: version, protocol number, both endpoints in the order of address bytes and port, and a discriminator; either direction has the same.

    The discriminator is ``ports``, the identifier of an ICMP echo, or type and code of another ICMP message. Columns
    of ports and ICMP fields that packets lack count as null.
    """
    has = lambda c: F.col(c) if c in packets.columns else F.lit(None).cast("int")
    end = lambda s: F.struct(packed_address(F.col(f"{s}_ip")).alias("packed"), F.coalesce(has(f"{s}_port"), F.lit(-1)).alias("port"), F.col(f"{s}_ip").alias("ip"))
    a, b = F.least(end("source"), end("destination")), F.greatest(end("source"), end("destination"))
    text = lambda e: F.concat_ws(":", e["ip"], e["port"])
    shown = lambda c: F.coalesce(has(c).cast("string"), F.lit("none"))
    other = F.when(has("icmp_type").isin(*ECHO), F.concat(F.lit("echo:"), shown("icmp_identifier"))).otherwise(F.concat_ws(":", F.lit("type"), shown("icmp_type"), F.lit("code"), shown("icmp_code")))
    return packets.withColumn("key", F.concat_ws("|", "ip_version", "protocol_number", F.concat_ws(">", text(a), text(b)), F.when(has("source_port").isNotNull(), "ports").otherwise(other)))


def segment_flows(packets: DataFrame, idle: float = 60.0, active: float = 300.0, most: int = 10_000) -> DataFrame:
    """packets (source_id, key, seq, micros, ...) with segment, for captures whose times never decrease.

    A segment ends when a packet comes ``idle`` seconds after its last or ``active`` seconds after its first (both
    inclusive), or when it holds ``most`` packets. A key's packets decide this alone: they pass in order, batch by batch, and no
    more of a key than the open segment's ends is held.
    """
    i, a = round(idle * 1e6), round(active * 1e6)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, segment, first, last, count = None, 0, 0, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch.column(c) for c in ("source_id", "key")]
            codes = [k.dictionary_encode().indices.fill_null(-1).to_numpy() for k in keys]
            fresh = np.ones(batch.num_rows, bool)
            fresh[1:] = (codes[0][1:] != codes[0][:-1]) | (codes[1][1:] != codes[1][:-1])
            fresh[0] = before != [k[0].as_py() for k in keys]
            before = [k[-1].as_py() for k in keys]
            out = []
            for t, new in zip(batch.column("micros").to_pylist(), fresh.tolist(), strict=True):
                if new:
                    segment = count = 0
                elif t - first >= a or t - last >= i or count >= most:
                    segment, count = segment + 1, 0
                if not count:
                    first = last = t
                first, last, count = min(first, t), max(last, t), count + 1
                out.append(segment)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], [*batch.schema.names, "segment"])

    schema = T.StructType([*packets.schema.fields, T.StructField("segment", T.LongType())])
    return packets.repartition("source_id", "key").sortWithinPartitions("source_id", "key", "seq").mapInArrow(run, schema)


class OpenFlows:
    """The open flows of one capture, [first, last, packets, segment] by key, with their deadlines in a heap.

    A packet, of whatever key, first ends all flows that it finds past their idle or active limit; a full flow of its own key ends too.
    A deadline that a later packet has moved is found stale when it comes up and is put back as it is now.
    """

    def __init__(self, idle: int, active: int, most: int) -> None:
        self.idle, self.active, self.most = idle, active, most
        self.open: dict[str, list[int]] = {}
        self.deadlines: list[tuple[int, str, int]] = []

    def due(self, flow: list[int]) -> int:
        return min(flow[0] + self.active, flow[1] + self.idle)

    def watch(self, key: str) -> None:
        flow = self.open[key]
        heapq.heappush(self.deadlines, (self.due(flow), key, flow[3]))

    def expired(self, t: int) -> Iterator[tuple[str, list[int], str]]:
        while self.deadlines and self.deadlines[0][0] <= t:
            _, key, segment = heapq.heappop(self.deadlines)
            flow = self.open.get(key)
            if flow is None or flow[3] != segment:
                continue
            if self.due(flow) > t:
                self.watch(key)
                continue
            del self.open[key]
            yield key, flow, "active_timeout" if t - flow[0] >= self.active else "idle_timeout"

    def packet(self, key: str, t: int, following: Callable[[str], int]) -> tuple[int, list[tuple[str, list[int], str]]]:
        """(the packet's segment, flows that it ends); following numbers a key's next segment."""
        ended = list(self.expired(t))
        flow = self.open.get(key)
        if flow and flow[2] >= self.most:
            ended.append((key, self.open.pop(key), "capacity"))
            flow = None
        if flow is None:
            flow = self.open[key] = [t, t, 0, following(key)]
            flow[2] = 1
            self.watch(key)
        else:
            earlier = t < flow[0]
            flow[0], flow[1], flow[2] = min(flow[0], t), max(flow[1], t), flow[2] + 1
            if earlier:
                # a late packet may bring the active limit forward
                self.watch(key)
        return flow[3], ended

    def rest(self) -> list[tuple[str, list[int], str]]:
        ended = [(key, flow, "capture_end") for key, flow in sorted(self.open.items())]
        self.open.clear()
        self.deadlines.clear()
        return ended


def segment_out_of_order(packets: DataFrame, idle: float = 60.0, active: float = 300.0, most: int = 10_000) -> DataFrame:
    """As segment_flows for captures with late packets, with each segment's reason: any packet of the capture may end any flow, so a capture is folded whole.

    Captures are bounded in records, so a group is too.
    """
    i, a = round(idle * 1e6), round(active * 1e6)

    def f(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("seq", kind="stable")
        flows, segments = OpenFlows(i, a, most), {}

        def following(key: str) -> int:
            segments[key] = segments.get(key, -1) + 1
            return segments[key]

        out, reasons = [], {}
        for key, t in zip(rows.key, rows.micros.tolist(), strict=True):
            segment, ended = flows.packet(key, t, following)
            out.append(segment)
            reasons.update({(k, flow[3]): reason for k, flow, reason in ended})
        reasons.update({(k, flow[3]): reason for k, flow, reason in flows.rest()})
        return rows.assign(segment=np.array(out, np.int64), reason=[reasons[x] for x in zip(rows.key, out, strict=True)])

    return packets.groupBy("source_id").applyInPandas(f, T.StructType([*packets.schema.fields, T.StructField("segment", T.LongType()), T.StructField("reason", T.StringType())]))


def end_reasons(segmented: DataFrame, idle: float, active: float, most: int) -> DataFrame:
    """(source_id, key, segment, reason): capacity, active_timeout, idle_timeout or capture_end.

    The first packet of the capture, of whatever key, at or after a segment's deadline decides: a forward as-of join. It
    is looked for in the deadline's stretch of time, and only where there is none, in the next stretch that has packets, so
    that no task sees a whole capture.
    """
    i, a = round(idle * 1e6), round(active * 1e6)
    per = segmented.groupBy("source_id", "key", "segment").agg(F.min("micros").alias("first"), F.max("micros").alias("last"), F.count(F.lit(1)).alias("n"))
    per = per.withColumn("next_t", F.lead("first").over(Window.partitionBy("source_id", "key").orderBy("segment")))
    stretch = F.floor(F.col("t") / i)
    marks = per.withColumn("t", F.least(F.col("first") + a, F.col("last") + i)).select("source_id", "t", stretch.alias("stretch"), F.lit(0).alias("kind"), F.struct("key", "segment", "first", "last", "n", "next_t").alias("mark"))
    ticks = segmented.select("source_id", F.col("micros").alias("t")).withColumn("stretch", stretch).withColumns({"kind": F.lit(1), "mark": F.lit(None).cast(marks.schema["mark"].dataType)})
    packet = F.when(F.col("kind") == 1, F.col("t"))
    # from the latest back, a packet before a deadline of the same time
    ahead = Window.partitionBy("source_id", "stretch").orderBy(F.desc("t"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, 0)
    found = marks.unionByName(ticks).withColumn("within", F.min(packet).over(ahead)).where("kind = 0")
    later = F.min("least").over(Window.partitionBy("source_id").orderBy(F.desc("stretch")).rowsBetween(Window.unboundedPreceding, -1))
    stretches = marks.unionByName(ticks).groupBy("source_id", "stretch").agg(F.min(packet).alias("least")).withColumn("later", later)
    found = found.join(stretches.select("source_id", "stretch", "later"), ["source_id", "stretch"]).select("source_id", "mark.*", F.coalesce("within", "later").alias("at"))
    reason = F.when((F.col("n") >= most) & F.col("next_t").isNotNull() & (F.col("at").isNull() | (F.col("at") > F.col("next_t"))), "capacity")
    return found.select("source_id", "key", "segment", reason.when(F.col("at").isNull(), "capture_end").when(F.col("at") - F.col("first") >= a, "active_timeout").otherwise("idle_timeout").alias("reason"))


def with_direction(packets: DataFrame, by: list[str]) -> DataFrame:
    """forward: whether the packet has the source endpoint, address and port, of its segment's first packet in arrival order."""
    source = F.struct("source_ip", F.coalesce("source_port", F.lit(-1)).alias("port"))
    return packets.withColumn("forward", source == F.min_by(source, "seq").over(Window.partitionBy(*by)))


def direction_counts(packets: DataFrame, by: list[str]) -> DataFrame:
    p = with_direction(packets, by)
    return p.groupBy(*by).agg(
        F.count_if("forward").alias("forward_packets"), F.count_if(~F.col("forward")).alias("backward_packets"),
        F.sum(F.when(F.col("forward"), F.col("network_bytes")).otherwise(0)).alias("forward_bytes"), F.sum(F.when(~F.col("forward"), F.col("network_bytes")).otherwise(0)).alias("backward_bytes"),
    )


def has_flag(mask: int) -> Column:
    return (F.col("protocol") == "tcp") & (F.col("tcp_flags").bitwiseAND(mask) != 0)


def tcp_flag_counts(packets: DataFrame, by: list[str]) -> DataFrame:
    """Packets with each flag, in all and by direction; other protocols have none."""
    side = {"": F.lit(True), "forward_": F.col("forward"), "backward_": ~F.col("forward")}
    return with_direction(packets, by).groupBy(*by).agg(*[F.count_if(has_flag(m) & on).alias(f"{s}{n}_count") for s, on in side.items() for n, m in FLAGS.items()])


def with_handshake(directed: DataFrame, by: list[str]) -> DataFrame:
    """t2: where (seq) the segment's handshake has got to its answer: forward SYN without ACK, later backward SYN with ACK."""
    w = Window.partitionBy(*by)
    p = directed.withColumn("t1", F.min(F.when(F.col("forward") & has_flag(2) & ~has_flag(16), F.col("seq"))).over(w))
    return p.withColumn("t2", F.min(F.when(~F.col("forward") & has_flag(2) & has_flag(16) & (F.col("seq") > F.col("t1")), F.col("seq"))).over(w)).drop("t1")


def completed() -> Column:
    """Over with_handshake: whether a forward ACK follows the answer."""
    return F.coalesce(F.bool_or(F.col("forward") & has_flag(16) & (F.col("seq") > F.col("t2"))), F.lit(False))


def failed() -> Column:
    """Over with_handshake: TCP with a reset, or a SYN and no handshake."""
    return F.bool_or(F.col("protocol") == "tcp") & ((F.count_if(has_flag(4)) > 0) | ((F.count_if(has_flag(2)) > 0) & ~completed()))


def handshake(packets: DataFrame, by: list[str]) -> DataFrame:
    return with_handshake(with_direction(packets, by), by).groupBy(*by).agg(completed().cast("long").alias("completed"), failed().cast("long").alias("failed"))


def inter_arrival(packets: DataFrame, by: list[str]) -> DataFrame:
    """iat and own_iat: microseconds since the packet before in time order, of the segment and of the same direction; null for the first."""
    p = packets if "forward" in packets.columns else with_direction(packets, by)
    since = lambda keys: F.col("micros") - F.lag("micros").over(Window.partitionBy(*keys).orderBy("micros", "seq"))
    return p.withColumns({"iat": since(by), "own_iat": since([*by, "forward"])})


def with_burst(packets: DataFrame, by: list[str], micros: int = 1_000_000) -> DataFrame:
    """near: the segment's packets within the second up to this one, ends included."""
    return packets.withColumn("near", F.count(F.lit(1)).over(Window.partitionBy(*by).orderBy("micros").rangeBetween(-micros, 0)))


def burst_score(packets: DataFrame, by: list[str], micros: int = 1_000_000) -> DataFrame:
    """Largest share of a segment's packets within any inclusive stretch of one second."""
    return with_burst(packets, by, micros).groupBy(*by).agg((F.max("near") / F.count(F.lit(1))).alias("burst"))


#: the features of a flow in their contractual order
FEATURES = (
    "total_packets", "total_bytes", "forward_packets", "backward_packets", "forward_bytes", "backward_bytes", "packets_per_second", "bytes_per_second", "forward_backward_packet_ratio", "forward_backward_byte_ratio",
    "mean_packet_size", "std_packet_size", "min_packet_size", "max_packet_size", "median_packet_size", "packet_size_q25", "packet_size_q75", "forward_mean_packet_size", "backward_mean_packet_size", "flow_duration",
    "mean_inter_arrival_time", "std_inter_arrival_time", "min_inter_arrival_time", "max_inter_arrival_time", "median_inter_arrival_time", "iat_q25", "iat_q75", "forward_mean_iat", "backward_mean_iat",
    "syn_count", "ack_count", "fin_count", "rst_count", "psh_count", "urg_count", "syn_ratio", "rst_ratio", "ack_ratio", "completed_handshake_indicator", "asymmetry_score", "connection_burst_score", "periodicity_score", "failed_connection_indicator",
)


def flow_features(packets: DataFrame, by: list[str]) -> DataFrame:
    """The FEATURES of each segment, from one shuffle by segment; empty statistics are 0, quantiles interpolate."""
    p = with_burst(inter_arrival(with_handshake(with_direction(packets, by), by), by), by)
    size, iat, own, fwd = F.col("network_bytes"), F.col("iat") / 1e6, F.col("own_iat") / 1e6, F.col("forward")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    quantiles = lambda c, names: [zero(F.percentile(c, F.lit(q))).alias(n) for q, n in zip((0.5, 0.25, 0.75), names, strict=True)]
    out = p.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_packets"), F.sum(size).alias("total_bytes"), F.count_if(fwd).alias("forward_packets"), F.count_if(~fwd).alias("backward_packets"),
        F.sum(F.when(fwd, size).otherwise(0)).alias("forward_bytes"), F.sum(F.when(~fwd, size).otherwise(0)).alias("backward_bytes"),
        F.avg(size).alias("mean_packet_size"), zero(F.stddev_pop(size)).alias("std_packet_size"), F.min(size).cast("double").alias("min_packet_size"), F.max(size).cast("double").alias("max_packet_size"),
        *quantiles(size, ("median_packet_size", "packet_size_q25", "packet_size_q75")),
        zero(F.avg(F.when(fwd, size))).alias("forward_mean_packet_size"), zero(F.avg(F.when(~fwd, size))).alias("backward_mean_packet_size"),
        ((F.max("micros") - F.min("micros")) / 1e6).alias("flow_duration"),
        zero(F.avg(iat)).alias("mean_inter_arrival_time"), zero(F.stddev_pop(iat)).alias("std_inter_arrival_time"), zero(F.min(iat)).alias("min_inter_arrival_time"), zero(F.max(iat)).alias("max_inter_arrival_time"),
        *quantiles(iat, ("median_inter_arrival_time", "iat_q25", "iat_q75")),
        zero(F.avg(F.when(fwd, own))).alias("forward_mean_iat"), zero(F.avg(F.when(~fwd, own))).alias("backward_mean_iat"),
        F.count("iat").alias("iats"), *[F.count_if(has_flag(m)).alias(f"{n}_count") for n, m in FLAGS.items()],
        completed().cast("long").alias("completed_handshake_indicator"), (F.max("near") / F.count(F.lit(1))).alias("connection_burst_score"), failed().cast("long").alias("failed_connection_indicator"),
    )
    n, f, b = F.col("total_packets"), F.col("forward_packets"), F.col("backward_packets")
    mean = F.col("mean_inter_arrival_time")
    out = out.withColumns({
        "packets_per_second": safe_ratio(n, F.col("flow_duration")), "bytes_per_second": safe_ratio(F.col("total_bytes"), F.col("flow_duration")),
        "forward_backward_packet_ratio": safe_ratio(f, b), "forward_backward_byte_ratio": safe_ratio(F.col("forward_bytes"), F.col("backward_bytes")),
        "syn_ratio": F.col("syn_count") / n, "rst_ratio": F.col("rst_count") / n, "ack_ratio": F.col("ack_count") / n,
        "asymmetry_score": safe_ratio(F.abs(F.col("forward_bytes") - F.col("backward_bytes")), F.col("total_bytes")),
        "periodicity_score": F.when((F.col("iats") < 3) | (mean <= 0), 0.0).otherwise(1 / (1 + F.col("std_inter_arrival_time") / F.when(mean > 0, mean))),
    })
    return out.select(*by, *FEATURES)


#: rows of a capture in one part of a carried window
PART = 65_536


def replay_gaps(packets: DataFrame, speed: float, cap: float) -> DataFrame:
    """delta to the packet before in arrival order, whether it is negative, and the capped delay at a speed, in seconds.

    A capture is cut into ranges of seq; the first of a range takes the last packet of the ranges before.
    """
    p = packets.withColumn("part", F.floor(F.col("seq") / PART))
    parts = p.groupBy("source_id", "part").agg(F.max_by("micros", "seq").alias("end"))
    parts = parts.select("source_id", "part", F.lag("end").over(Window.partitionBy("source_id").orderBy("part")).alias("carried"))
    p = p.join(parts, ["source_id", "part"])
    before = F.coalesce(F.lag("micros").over(Window.partitionBy("source_id", "part").orderBy("seq")), F.col("carried"))
    p = p.withColumn("delta", F.coalesce((F.col("micros") - before) / 1e6, F.lit(0.0)))
    wait = F.greatest(F.col("delta"), F.lit(0.0)) / speed
    return p.select("source_id", "seq", "delta", (F.col("delta") < 0).alias("out_of_order"), F.least(wait, F.lit(cap)).alias("delay"), (wait > cap).alias("capped"))


def active_peak(segments: DataFrame, stretch: int = 3_600_000_000) -> DataFrame:
    """Largest number of segments (source_id, first, last) open at once, per capture; one that ends as another starts counts for both.

    Equal times are summed first; stretches of ``stretch`` microseconds are summed, and each starts from the sum before it.
    """
    ends = segments.select("source_id", F.col("first").alias("t"), F.lit(1).alias("d")).union(segments.select("source_id", F.col("last").alias("t"), F.lit(-1)))
    ends = ends.groupBy("source_id", F.floor(F.col("t") / stretch).alias("part"), "t", "d").agg(F.sum("d").alias("sum"))
    parts = ends.groupBy("source_id", "part").agg(F.sum("sum").alias("all"))
    before = F.sum("all").over(Window.partitionBy("source_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("source_id", "part", F.coalesce(before, F.lit(0)).alias("carried"))
    w = Window.partitionBy("source_id", "part").orderBy("t", F.desc("d")).rowsBetween(Window.unboundedPreceding, 0)
    return ends.withColumn("open", F.sum("sum").over(w)).join(parts, ["source_id", "part"]).groupBy("source_id").agg(F.max(F.col("open") + F.col("carried")).alias("peak"))


def capture_profile(packets: DataFrame, segments: DataFrame) -> DataFrame:
    p = packets.groupBy("source_id").agg(F.count(F.lit(1)).alias("packets"), ((F.max("micros") - F.min("micros")) / 1e6).alias("seconds"))
    return p.join(segments.groupBy("source_id").agg(F.count(F.lit(1)).alias("flows")), "source_id")
