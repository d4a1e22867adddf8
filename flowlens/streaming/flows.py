"""Flows from a stream of packets, in their order of arrival and none of them dropped."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from flowlens.operators.flows import OpenFlows

OUT = "source_id string, key string, segment long, first long, last long, packets long, late long, reason string"
COLUMNS = [c.split()[0] for c in OUT.split(", ")]


class FlowProcessor(StatefulProcessor):
    """State of a capture: its open flows by key, the segments that each key has had, the latest packet time."""

    def __init__(self, idle: int, active: int, most: int, silence: int | None) -> None:
        self.limits, self.silence = (idle, active, most), silence

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "key string", "first long, last long, packets long, segment long, late long")
        self.segments = handle.getMapState("segments", "key string", "next long")
        self.newest = handle.getValueState("newest", "micros long, timer long")

    def following(self, key: str) -> int:
        had = self.segments.getValue((key,)) if self.segments.containsKey((key,)) else (0,)
        self.segments.updateValue((key,), (had[0] + 1,))
        return had[0]

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        arrived = pd.concat(rows).sort_values("seq", kind="stable")
        flows, late, before = OpenFlows(*self.limits), {}, {}
        for (k,), (*flow, late[k]) in self.open.iterator():
            flows.open[k] = [int(x) for x in flow]
            before[k] = (*flows.open[k], late[k])
            flows.watch(k)
        newest, timer = self.newest.get() if self.newest.exists() else (None, None)
        out: list[tuple] = []

        def ended(found: list[tuple[str, list[int], str]]) -> None:
            out.extend((key[0], k, segment, first, last, n, late.pop(k), reason) for k, (first, last, n, segment), reason in found)

        for k, t, end in zip(arrived.key, arrived.micros, arrived.end, strict=True):
            if end:
                ended(flows.rest())
                continue
            t = int(t)
            was = flows.open.get(k)
            _, found = flows.packet(k, t, self.following)
            ended(found)
            if flows.open[k] is not was:
                late[k] = 0
            late[k] += newest is not None and t < newest
            newest = t if newest is None else max(newest, t)
        for k in before.keys() - flows.open.keys():
            self.open.removeKey((k,))
        for k, flow in flows.open.items():
            if before.get(k) != (now := (*flow, late[k])):
                self.open.updateValue((k,), now)
        if self.silence is not None:
            if timer:
                self.handle.deleteTimer(timer)
            timer = timerValues.getCurrentProcessingTimeInMs() + self.silence
            self.handle.registerTimer(timer)
        self.newest.update((newest, timer))
        yield pd.DataFrame(out, columns=COLUMNS)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        left = sorted(((k, [int(x) for x in state]) for (k,), state in self.open.iterator()))
        for k, _ in left:
            self.open.removeKey((k,))
        newest = self.newest.get() if self.newest.exists() else (None, None)
        self.newest.update((newest[0], None))
        yield pd.DataFrame([(key[0], k, segment, first, last, n, late, "capture_end") for k, (first, last, n, segment, late) in left], columns=COLUMNS)

    def close(self) -> None:
        pass


def stream_flows(packets: DataFrame, idle: float, active: float, most: int, silence: float | None = None) -> DataFrame:
    """Segments (OUT) of a stream of packets (source_id, key, seq, micros, end) as they end, as segment_out_of_order has them.

    A capture's packets meet in one state, for any of them may end any of its flows; captures run side by side. Limits go by the
    packets' own times in the order of seq, and no watermark stands before the state, so that late packets join the flow
    that is open or open one, and none is dropped; ``late`` counts a flow's packets older than one that came before. A row with ``end`` says that the
    capture is over: what is open ends as capture_end, as it does after ``silence`` seconds without a row, where that is given.
    """
    processor = FlowProcessor(round(idle * 1e6), round(active * 1e6), most, None if silence is None else round(silence * 1000))
    rows = packets.select("source_id", "key", "seq", "micros", "end")
    return rows.groupBy("source_id").transformWithStateInPandas(processor, OUT, "Append", "None" if silence is None else "ProcessingTime")
