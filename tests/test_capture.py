import struct

from flowlens.operators import flows as W
from flowlens.sources.capture import decode_frames, read_frames


def ip4(proto, body, flags=0):
    return struct.pack(">BBHHHBBH4s4s", 0x45, 0, 20 + len(body), 1, flags, 64, proto, 0, bytes([192, 0, 2, 1]), bytes([198, 51, 100, 2])) + body


TCP = struct.pack(">HHIIBBHHH", 40000, 443, 0, 0, 0x50, 0x12, 0, 0, 0)
UDP = struct.pack(">HHHH", 53, 5353, 8, 0)
V6 = struct.pack(">IHBB", 0x60000000, 8, 17, 64) + bytes.fromhex("20010db8000000000000000000000001") + bytes.fromhex("20010db8000000000000000000000002") + UDP
ETH = b"\0" * 12
FRAMES = [ETH + b"\x08\x00" + ip4(6, TCP), ETH + b"\x81\x00\0\1\x08\x00" + ip4(17, UDP), ETH + b"\x86\xdd" + V6, ETH + b"\x08\x06" + b"\0" * 28, ETH + b"\x08\x00" + ip4(6, TCP, 0x2000), ETH + b"\x08\x00" + ip4(6, TCP)[:30], ETH + b"\x08\x00" + ip4(1, b"\x08\0\0\0\0\x2a\0\1")]


def classic(order, magic, units):
    head = struct.pack(f"{order}IHHiIII", magic, 2, 4, 0, 0, 65535, 1)
    return head + b"".join(struct.pack(f"{order}IIII", 1000 + i, units // 2, len(f), len(f)) + f for i, f in enumerate(FRAMES))


def test_classic_and_decode(spark, tmp_path):
    (tmp_path / "a.pcap").write_bytes(classic("<", 0xA1B2C3D4, 10**6))
    (tmp_path / "b.pcap").write_bytes(classic(">", 0xA1B23C4D, 10**9))
    frames = read_frames(spark, f"file://{tmp_path}")
    assert frames.rdd.getNumPartitions() == 2 and frames.count() == 14
    assert {r["micros"] for r in frames.where("seq = 0").collect()} == {1_000_500_000}
    rows = decode_frames(frames.where("source_id like '%a.pcap'")).orderBy("seq").collect()
    assert [(r["protocol"], r["source_port"], r["destination_port"], r["tcp_flags"]) for r in rows[:3]] == [("tcp", 40000, 443, 0x12), ("udp", 53, 5353, None), ("udp", 53, 5353, None)]
    assert rows[0]["source_ip"] == "192.0.2.1" and rows[0]["network_bytes"] == 40 and rows[2]["ip_version"] == 6
    assert [r["skip_reason"] for r in rows] == [None, None, None, "not_ip", "fragment", None, None] and [r["error"] for r in rows] == [None] * 5 + ["length", None]
    assert (rows[6]["icmp_type"], rows[6]["icmp_code"]) == (8, 0)


def test_blocks(spark, tmp_path):
    block = lambda kind, body: struct.pack("<II", kind, 12 + len(body)) + body + struct.pack("<I", 12 + len(body))
    f = FRAMES[0] + b"\0" * (-len(FRAMES[0]) % 4)
    data = block(0x0A0D0D0A, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1)) + block(1, struct.pack("<HHI", 1, 0, 0) + struct.pack("<HHB3x", 9, 1, 9) + b"\0" * 4) + block(6, struct.pack("<IIIII", 0, 0, 2_500_000_000, len(FRAMES[0]), 60) + f)
    (tmp_path / "c.pcapng").write_bytes(data)
    row = read_frames(spark, f"file://{tmp_path}/c.pcapng").first()
    assert (row["micros"], row["original_length"], bytes(row["frame"])) == (2_500_000, 60, FRAMES[0])


def v6(proto, body, size=None):
    ends = bytes.fromhex("20010db8000000000000000000000001") + bytes.fromhex("20010db8000000000001000000000002")
    return struct.pack(">IHBB", 0x60000000, len(body) if size is None else size, proto, 64) + ends + body


def decoded(spark, packets, link=101):
    df = spark.createDataFrame([("c", i, 0, link, len(p), bytearray(p)) for i, p in enumerate(packets)], "source_id string, seq long, micros long, link_type int, original_length long, frame binary")
    return decode_frames(df).orderBy("seq").collect()


def test_extension_headers(spark):
    hop, padded = bytes([6, 0]) + b"\0" * 6, bytes([17, 1]) + b"\0" * 14
    whole, part = bytes([6, 0, 0, 0]) + b"\0" * 4, bytes([6, 0, 0, 9]) + b"\0" * 4
    auth = bytes([17, 4]) + b"\0" * 22
    rows = decoded(spark, [
        v6(0, hop + TCP), v6(60, padded + UDP), v6(44, whole + TCP), v6(44, part + TCP), v6(51, auth + UDP), v6(0, bytes([43, 0]) + b"\0" * 6 + bytes([60, 0]) + b"\0" * 6 + bytes([6, 0]) + b"\0" * 6 + TCP),
        v6(0, bytes([6, 9]) + b"\0" * 6 + TCP), v6(44, bytes([6, 0, 0])), v6(6, TCP, 0), v6(6, TCP, 99), v6(0, bytes([59, 0]) + b"\0" * 6), v6(6, TCP)[:30], v6(0, bytes([6, 0]) + b"\0" * 6 + TCP[:10]),
    ])
    assert [(r["protocol"], r["source_port"], r["network_bytes"]) for r in (rows[0], rows[1], rows[2], rows[4], rows[5])] == [("tcp", 40000, 68), ("udp", 53, 64), ("tcp", 40000, 68), ("udp", 53, 72), ("tcp", 40000, 84)]
    assert [(r["skip_reason"], r["error"]) for r in rows] == [(None, None)] * 3 + [("fragment", None)] + [(None, None)] * 2 + [(None, "length"), (None, "length"), (None, "jumbo"), (None, "length"), ("protocol", None), (None, "header"), (None, "length")]
    assert (rows[0]["source_ip"], rows[0]["destination_ip"]) == ("2001:db8::1", "2001:db8::1:0:0:2")


def test_long_chain(spark):
    body = (bytes([60, 0]) + b"\0" * 6) * 40 + bytes([17, 0]) + b"\0" * 6 + UDP
    assert decoded(spark, [v6(60, body)])[0]["source_port"] == 53


def test_echo_identifiers(spark):
    echo = lambda kind: bytes([kind, 0, 0, 0, 1, 2, 0, 7])
    rows = decoded(spark, [ip4(1, echo(8)), ip4(1, echo(0)), ip4(1, echo(3)), ip4(1, echo(8)[:6]), v6(58, echo(128)), v6(58, echo(8)), ip4(1, b"\3\1\0\0")])
    assert [r["icmp_identifier"] for r in rows] == [258, 258, None, None, 258, None, None] and [r["error"] for r in rows] == [None] * 3 + ["length"] + [None] * 3
    keys = W.with_flow_key(decode_frames(spark.createDataFrame([("c", i, 0, 101, 28, bytearray(ip4(1, bytes([8, 0, 0, 0, 0, i, 0, 1])))) for i in (1, 2)], "source_id string, seq long, micros long, link_type int, original_length long, frame binary"))).collect()
    assert len({r["key"] for r in keys}) == 2 and keys[0]["key"].endswith("echo:1")


def test_transport_lengths(spark):
    short, far = TCP[:12] + b"\x40" + TCP[13:], TCP[:12] + b"\x60" + TCP[13:]
    udp = lambda n: struct.pack(">HHHH", 53, 5353, n, 0) + b"ab"
    rows = decoded(spark, [ip4(6, short), ip4(6, far), ip4(6, far + b"\0" * 4), ip4(17, udp(7)), ip4(17, udp(11)), ip4(17, udp(10)), ip4(17, udp(9))])
    assert [r["error"] for r in rows] == ["length", "length", None, "length", "length", None, None]


def test_versions_have_to_agree(spark):
    assert decoded(spark, [v6(6, TCP)], 228)[0]["error"] == "header" and decoded(spark, [ip4(6, TCP)], 228)[0]["protocol"] == "tcp"
    assert decoded(spark, [b"\x10" + TCP])[0]["skip_reason"] == "not_ip" and decoded(spark, [b""], 999)[0]["skip_reason"] == "link_type"
