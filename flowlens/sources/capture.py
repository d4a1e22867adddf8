"""Capture files as tables of frames, and frames as packets."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.functions.scalars import normalize_ip
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "source_id string, seq long, micros long, link_type int, original_length long, frame binary"
#: classic magic: byte order and units a second
MAGICS = {b"\xa1\xb2\xc3\xd4": (">", 10**6), b"\xd4\xc3\xb2\xa1": ("<", 10**6), b"\xa1\xb2\x3c\x4d": (">", 10**9), b"\x4d\x3c\xb2\xa1": ("<", 10**9)}
LARGEST = 262_144


def classic(data: bytes) -> Iterator[tuple[int, int, int, bytes]]:
    """(micros, link type, original length, frame) of a classic capture; a cut record is an error."""
    order, units = MAGICS[data[:4]]
    link, at = struct.unpack_from(f"{order}I", data, 20)[0] & 0xFFFF, 24
    while at < len(data):
        if at + 16 > len(data):
            raise ValueError("a record header is cut off")
        seconds, fraction, held, original = struct.unpack_from(f"{order}IIII", data, at)
        if held > LARGEST or at + 16 + held > len(data) or fraction >= units:
            raise ValueError("a record is out of bounds")
        yield seconds * 10**6 + fraction * 10**6 // units, link, original, data[at + 16 : at + 16 + held]
        at += 16 + held


def blocks(data: bytes) -> Iterator[tuple[int, int, int, bytes]]:
    """The same of a block capture with one section: interface and enhanced packet blocks; a simple one has no time and is an error."""
    order = "<" if data[8:12] == b"\x4d\x3c\x2b\x1a" else ">"
    interfaces: list[tuple[int, int]] = []
    at, sections = 0, 0
    while at < len(data):
        if at + 12 > len(data):
            raise ValueError("a block is cut off")
        kind, size = struct.unpack_from(f"{order}II", data, at)
        if size < 12 or size % 4 or at + size > len(data):
            raise ValueError("a block is out of bounds")
        body = data[at + 8 : at + size - 4]
        if kind == 0x0A0D0D0A:
            sections += 1
            if sections > 1:
                raise ValueError("more than one section")
        elif kind == 1:
            units, o = 10**6, 8
            while o + 4 <= len(body):
                code, n = struct.unpack_from(f"{order}HH", body, o)
                if code == 9:
                    r = body[o + 4]
                    units = 2 ** (r & 127) if r & 128 else 10**r
                if not code:
                    break
                o += 4 + (n + 3) // 4 * 4
            interfaces.append((struct.unpack_from(f"{order}H", body)[0], units))
        elif kind == 6:
            i, high, low, held, original = struct.unpack_from(f"{order}IIIII", body)
            if i >= len(interfaces) or held > LARGEST or 20 + held > len(body):
                raise ValueError("a packet block is out of bounds")
            link, units = interfaces[i]
            yield (high << 32 | low) * 10**6 // units, link, original, body[20 : 20 + held]
        elif kind == 3:
            raise ValueError("a simple packet block has no time")
        at += size


@dataclass
class CapturePart(InputPartition):
    file: str


class CaptureReader(DataSourceReader):
    """One partition for each file; framing within a file is sequential."""

    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[CapturePart]:
        fs, root = pafs.FileSystem.from_uri(self.path)
        if fs.get_file_info(root).type == pafs.FileType.File:
            return [CapturePart(root)]
        return [CapturePart(f.path) for f in sorted(fs.get_file_info(pafs.FileSelector(root)), key=lambda f: f.path) if f.type == pafs.FileType.File]

    def read(self, partition: CapturePart) -> Iterator[tuple]:
        fs, _ = pafs.FileSystem.from_uri(self.path)
        with fs.open_input_stream(partition.file, compression=None) as stream:
            data = stream.read()
        frames = classic(data) if data[:4] in MAGICS else blocks(data) if data[:4] == b"\x0a\x0d\x0d\x0a" else None
        if frames is None:
            raise ValueError("not a capture file")
        for seq, (micros, link, original, frame) in enumerate(frames):
            yield partition.file, seq, micros, link, original, frame


class CaptureSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "capture"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> CaptureReader:
        return CaptureReader(self.options["path"])


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(CaptureSource)
    return spark.read.format("capture").load(path)


def number(frame: Column, at: Column | int, size: int) -> Column:
    """The big-endian number of some bytes; null beyond the end."""
    at = F.lit(at) if isinstance(at, int) else at
    return F.when(F.octet_length(frame) >= at + size, F.conv(F.hex(F.substring(frame, at + 1, F.lit(size))), 16, 10).cast("long"))


#: IPv6 headers that lead on to another: options by hop, routing, destination options; fragment; authentication
OPTIONS, FRAGMENT, AUTHENTICATION = (0, 43, 60), 44, 51


def after_extensions(f: Column, start: Column, following: Column, end: Column) -> Column:
    """(at, following, problem) behind a chain of IPv6 extension headers: a fold over at most as many as have room before end.

    A fragment is a problem of its own, "fragment"; a header that goes on beyond the end is "length".
    """
    leads = lambda n: n.isin(*OPTIONS, FRAGMENT, AUTHENTICATION)

    def step(state: Column, _: Column) -> Column:
        at, n = state["at"], state["following"]
        own = number(f, at + 1, 1)
        size = F.when(n == FRAGMENT, 8).when(n == AUTHENTICATION, (own + 2) * 4).otherwise((own + 1) * 8)
        problem = F.when(size.isNull() | (at + size > end), "length").when((n == FRAGMENT) & (number(f, at + 2, 2).bitwiseAND(0xFFF9) != 0), "fragment")
        on = F.struct((at + size).cast("long").alias("at"), number(f, at, 1).alias("following"), F.lit(None).cast("string").alias("problem"))
        stop = F.struct(at.alias("at"), n.alias("following"), problem.alias("problem"))
        return F.when(state["problem"].isNotNull() | ~leads(n), state).when(problem.isNotNull(), stop).otherwise(on)

    first = F.struct(start.cast("long").alias("at"), following.cast("long").alias("following"), F.lit(None).cast("string").alias("problem"))
    # no header is shorter than eight bytes
    chain = F.aggregate(F.sequence(F.lit(1), F.floor((end - start) / 8).cast("int") + 1), first, step)
    return F.when(leads(following) & (end >= start), chain).otherwise(first)


def decode_frames(frames: DataFrame) -> DataFrame:
    """frames with the packet's columns, or a skip_reason, or an error.

    Ethernet with up to two VLAN tags and raw IP; IPv4 with options, IPv6 with its chain of extension headers; TCP, UDP and
    ICMP with the identifier of an echo. Fragments and other contents are skipped; versions and lengths that don't fit, jumbo
    payloads among them, are errors. IPv6 addresses are in their shortest form.
    """
    f = F.col("frame")
    tag = lambda at: number(f, at, 2)
    vlan = lambda t: t.isin(0x8100, 0x88A8)
    tags = F.when(vlan(tag(12)) & vlan(tag(16)), 2).when(vlan(tag(12)), 1).otherwise(0)
    df = frames.withColumn("o", F.when(F.col("link_type") == 1, 14 + 4 * tags).when(F.col("link_type").isin(12, 101, 228, 229), 0))
    o = F.col("o")
    nibble = F.shiftright(number(f, o, 1), 4)
    kind = F.when(F.col("link_type") == 1, F.when(number(f, o - 2, 2) == 0x0800, 4).when(number(f, o - 2, 2) == 0x86DD, 6)).when(F.col("link_type") == 228, 4).when(F.col("link_type") == 229, 6).otherwise(nibble)
    df = df.withColumns({"v": kind.cast("int"), "nibble": nibble})
    v4, v6 = F.col("v") == 4, F.col("v") == 6
    total = F.when(v4, number(f, o + 2, 2)).otherwise(number(f, o + 4, 2) + 40)
    df = df.withColumns({"network_bytes": total, "payload": number(f, o + 4, 2), "frag": v4 & (number(f, o + 6, 2).bitwiseAND(0x3FFF) != 0)})
    fits = F.octet_length(f) >= o + F.col("network_bytes")
    chain = F.when(v6 & fits, after_extensions(f, o + 40, number(f, o + 6, 1), o + F.col("network_bytes")))
    df = df.withColumn("chain", chain)
    df = df.withColumns({"h": F.when(v4, number(f, o, 1).bitwiseAND(15) * 4).otherwise(F.coalesce(F.col("chain.at") - o, F.lit(40))), "protocol_number": F.when(v4, number(f, o + 9, 1)).otherwise(F.coalesce(F.col("chain.following"), number(f, o + 6, 1)))})
    p, t = F.col("protocol_number"), o + F.col("h")
    byte = lambda at: number(f, at, 1).cast("string")
    ip4 = lambda at: F.concat_ws(".", *[byte(at + i) for i in range(4)])
    ip6 = lambda at: normalize_ip(F.concat_ws(":", *[F.lower(F.hex(F.substring(f, at + 1 + 2 * i, F.lit(2)))) for i in range(8)]))
    tcp, udp, icmp = p == 6, p == 17, p.isin(1, 58)
    kind = number(f, t, 1)
    echo = icmp & F.when(p == 1, kind.isin(0, 8)).otherwise(kind.isin(128, 129))
    need = F.when(tcp, 20).when(udp, 8).when(F.coalesce(echo, F.lit(False)), 8).when(icmp, 4).otherwise(0)
    # the header's own length, in words or bytes, lies within the payload
    own = F.when(tcp, F.shiftright(number(f, t + 12, 1), 4) * 4).when(udp, number(f, t + 4, 2))
    unfit = F.coalesce((own < need) | (own > F.col("network_bytes") - F.col("h")), F.lit(False))
    problem = F.col("chain.problem")
    skip = F.when(o.isNull(), "link_type").when(F.col("v").isNull() | ~F.col("v").isin(4, 6), "not_ip").when(F.col("frag") | F.coalesce(problem == "fragment", F.lit(False)), "fragment").when(~(tcp | udp | icmp), "protocol")
    ip = F.col("v").isin(4, 6) & o.isNotNull()
    header = F.when(v4, F.col("h") < 20).otherwise(F.octet_length(f) < o + 40)
    error = F.when(
        ip,
        F.when(F.col("network_bytes").isNull() | header | (F.col("nibble") != F.col("v")), "header")
        .when(v6 & (F.col("payload") == 0), "jumbo")
        .when(~fits | F.coalesce(problem == "length", F.lit(False)) | (F.col("network_bytes") < F.col("h")), "length")
        .when((skip.isNull()) & ((F.col("network_bytes") < F.col("h") + need) | unfit), "length"),
    )
    df = df.withColumns({"error": error, "skip_reason": F.when(error.isNull(), skip)})
    good = F.col("error").isNull() & F.col("skip_reason").isNull()
    port = lambda at: F.when(good & (tcp | udp), number(f, at, 2).cast("int"))
    return df.select(
        "source_id", "seq", "micros", F.col("v").alias("ip_version"), F.when(good, F.when(v4, ip4(o + 12)).otherwise(ip6(o + 8))).alias("source_ip"), F.when(good, F.when(v4, ip4(o + 16)).otherwise(ip6(o + 24))).alias("destination_ip"),
        port(t).alias("source_port"), port(t + 2).alias("destination_port"), F.when(tcp, "tcp").when(udp, "udp").when(icmp, "icmp").alias("protocol"), "protocol_number", "network_bytes",
        F.when(good & tcp, number(f, t + 13, 1)).alias("tcp_flags"), F.when(good & icmp, kind).alias("icmp_type"), F.when(good & icmp, number(f, t + 1, 1)).alias("icmp_code"), F.when(good & echo, number(f, t + 4, 2)).alias("icmp_identifier"), "skip_reason", "error",
    )
