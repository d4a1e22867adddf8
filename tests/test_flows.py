import random

import pytest

from flowlens.operators import flows as W
from flowlens.sources import files

SCHEMA = "source_id string, key string, seq long, micros long"


def rows(times, key="k"):
    return [("c", key, i, round(t * 1e6)) for i, t in enumerate(times)]


def segments(df):
    return [r["segment"] for r in df.orderBy("seq").collect()]


@pytest.mark.parametrize("times, want", [([0, 59.999, 119.998], [0, 0, 0]), ([0, 60], [0, 1]), ([0, 50, 100, 150, 200, 250, 299, 300], [0] * 7 + [1])])
def test_timeouts_are_inclusive(spark, times, want):
    df = spark.createDataFrame(rows(times), SCHEMA)
    assert segments(W.segment_flows(df)) == want
    assert segments(W.segment_out_of_order(df)) == want


def test_capacity(spark):
    df = spark.createDataFrame(rows([5, 4, 3]), SCHEMA)
    assert segments(W.segment_flows(df, most=1)) == [0, 1, 2]


def test_folds_agree_in_order(spark):
    rng = random.Random(4)
    t, out = 0.0, []
    for i in range(400):
        t += rng.choice([0, 1, 20, 70])
        out.append(("c", f"k{rng.randrange(6)}", i, round(t * 1e6)))
    df = spark.createDataFrame(out, SCHEMA)
    assert segments(W.segment_flows(df, most=5)) == segments(W.segment_out_of_order(df, most=5))


def test_reasons_and_late_packets_of_the_fold(spark):
    # the packet at 10 comes late: it lowers the first time of its open flow, and finds nobody else's limit passed
    times = [("a", 100), ("b", 100), ("a", 10), ("b", 159.9), ("c", 311), ("a", 311), ("d", 500)]
    df = spark.createDataFrame([("s", k, i, round(t * 1e6)) for i, (k, t) in enumerate(times)], SCHEMA)
    got = [(r["key"], r["segment"], r["reason"]) for r in W.segment_out_of_order(df).orderBy("seq").collect()]
    assert got == [("a", 0, "active_timeout"), ("b", 0, "idle_timeout"), ("a", 0, "active_timeout"), ("b", 0, "idle_timeout"), ("c", 0, "idle_timeout"), ("a", 1, "idle_timeout"), ("d", 0, "capture_end")]


def test_fold_equals_a_scan_of_all_open_flows(spark):
    rng = random.Random(6)
    rows, t = [], 1000.0
    for i in range(1500):
        t += rng.choice([0, 0.5, 3, 20])
        rows.append(("s", f"k{rng.randrange(12)}", i, round((t - (rng.choice([5, 70, 400]) if rng.random() < 0.2 else 0)) * 1e6)))
    open_, index, want = {}, {}, []
    for _, key, _, m in rows:
        for k in [k for k, (first, last, _) in open_.items() if m - first >= 300e6 or m - last >= 60e6]:
            del open_[k]
        if key in open_ and open_[key][2] >= 7:
            del open_[key]
        if key not in open_:
            index[key] = index.get(key, -1) + 1
            open_[key] = (m, m, 0)
        first, last, n = open_[key]
        open_[key] = (min(first, m), max(last, m), n + 1)
        want.append(index[key])
    assert segments(W.segment_out_of_order(spark.createDataFrame(rows, SCHEMA), most=7)) == want


def test_files(spark, tmp_path):
    names = "first_seen,last_seen,duration,source_ip,destination_ip,source_port,destination_port,protocol,forward_packet_count,backward_packet_count,forward_bytes,backward_bytes"
    (tmp_path / "f.csv").write_text(f"{names}\n2026-01-01T00:00:00Z,2026-01-01T00:00:01Z,1.0,10.0.0.1,10.0.0.2,1,,udp,1,1,75,91\nx,y\n")
    got = files.read_flow_csv(spark, str(tmp_path / "f.csv")).collect()
    assert got[0]["forward_bytes"] == 75 and got[0]["destination_port"] is None and got[1]["_corrupt"]
    (tmp_path / "g.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError, match="header"):
        files.read_flow_csv(spark, str(tmp_path / "g.csv"))
    (tmp_path / "e.jsonl").write_text('{"a":1}\n\n[1]\n{"a":NaN}\n{"a":{"b":1}}\n')
    assert [r["error"] for r in files.read_json_events(spark, str(tmp_path / "e.jsonl")).collect()] == [None, "blank", "not_an_object", "malformed", None]
    df = spark.createDataFrame([(1, "train"), (2, "test")], "a long, split string")
    files.write_splits(df, str(tmp_path / "s"))
    assert sorted(p.name for p in (tmp_path / "s").glob("split=*")) == ["split=test", "split=train"]
    files.write_dataset_rows(df, str(tmp_path / "r"))
    assert files.read_dataset_rows(spark, str(tmp_path / "r"), "a long, split string").count() == 2


PACKETS = "source_id string, seq long, micros long, ip_version int, source_ip string, destination_ip string, source_port int, destination_port int, protocol string, protocol_number int, icmp_type int, icmp_code int, icmp_identifier int, network_bytes long, tcp_flags long"


def packet(seq, source, destination, protocol="tcp", number=6, icmp=(None, None, None), version=4, flags=0, size=100, t=0.0):
    return ("c", seq, round(t * 1e6), version, source[0], destination[0], source[1], destination[1], protocol, number, *icmp, size, flags)


def test_keys(spark):
    a, b, x, y = ("10.0.0.9", 5000), ("10.0.0.10", 80), ("2001:db8::1", 1), ("2001:db8:0:0:0:0:0:2", 2)
    none = lambda e: (e[0], None)
    rows = [
        packet(0, a, b), packet(1, b, a), packet(2, a, b, "udp", 17), packet(3, x, y, version=6), packet(4, y, x, version=6),
        packet(5, none(a), none(b), "icmp", 1, (8, 0, 42)), packet(6, none(b), none(a), "icmp", 1, (0, 0, 42)), packet(7, none(a), none(b), "icmp", 1, (8, 0, 43)), packet(8, none(a), none(b), "icmp", 1, (3, 1, None)),
    ]
    keys = [r["key"] for r in W.with_flow_key(spark.createDataFrame(rows, PACKETS)).orderBy("seq").collect()]
    # bytes order the addresses, not text
    assert keys[0] == keys[1] == "4|6|10.0.0.9:5000>10.0.0.10:80|ports"
    assert keys[3] == keys[4] and keys[5] == keys[6] and len(set(keys)) == 6
    assert keys[5].endswith("|echo:42") and keys[8].endswith("|type:3:code:1")


def test_features_of_a_handshake_between_ports_of_one_host(spark):
    a, b = ("10.0.0.1", 5000), ("10.0.0.1", 80)
    rows = [packet(0, a, b, flags=2, t=0), packet(1, b, a, flags=18, t=0.5, size=300), packet(2, a, b, flags=16, t=1.0), packet(3, a, b, flags=24, t=3.0)]
    df = W.segment_flows(W.with_flow_key(spark.createDataFrame(rows, PACKETS)))
    got = W.flow_features(df, ["source_id", "key", "segment"]).first().asDict()
    assert tuple(got)[3:] == W.FEATURES and len(W.FEATURES) == 43
    assert (got["forward_packets"], got["backward_packets"], got["completed_handshake_indicator"], got["failed_connection_indicator"]) == (3, 1, 1, 0)
    assert got["asymmetry_score"] == 0.0 and got["forward_mean_iat"] == 1.5 and got["backward_mean_iat"] == 0.0 and got["connection_burst_score"] == 0.75
    single = W.flow_features(df.where("seq = 0"), ["source_id", "key", "segment"]).first().asDict()
    assert all(v is not None and v == v for v in single.values()) and single["failed_connection_indicator"] == 1
