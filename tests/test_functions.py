import ipaddress
import uuid

from pyspark.sql import functions as F

from flowlens.functions import scalars as S


def one(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_addresses(spark):
    good = ["10.0.0.1", "2001:DB8:0:0:0:0:0:1", "::", "::1", "1::", "1:0:0:2:0:0:0:3", "fe80::0202:b3ff:fe1e:8329", "0:0:1:0:0:0:0:0", "1:2:3:4:5:6:7:8", "1:0:2:3:4:5:6:7"]
    bad = ["256.1.1.1", "1.2.3", "1:2:3", ":::", "g::1", "1::2::3", "", "1:2:3:4:5:6:7:8:9"]
    assert one(spark, [(a,) for a in good + bad], "a string", S.normalize_ip(F.col("a"))) == [str(ipaddress.ip_address(a)) for a in good] + [None] * len(bad)


def test_uuid5(spark):
    ns = uuid.NAMESPACE_URL
    names = ["", "a", "é:1|2", "x" * 300]
    assert one(spark, [(n,) for n in names], "n string", S.uuid5(ns, F.col("n"))) == [str(uuid.uuid5(ns, n)) for n in names]


def test_times_depth_ratio(spark):
    assert one(spark, [("2024-01-01T00:00:00Z",), ("2024-01-01T02:00:00+02:00",), ("2024-01-01T00:00:00",), ("x",)], "t string", F.unix_seconds(S.parse_utc(F.col("t")))) == [1704067200, 1704067200, None, None]
    assert one(spark, [(1, 999_999_999), (1, 1_000_000_000)], "s long, f long", S.epoch_micros(F.col("s"), F.col("f"), 10**9)) == [1_999_999, None]
    assert one(spark, [('{"a":[1,{"b":"]]{{"}]}',), ("[]",), ("1",)], "t string", S.json_depth(F.col("t"))) == [3, 1, 0]
    assert one(spark, [(1.0, 0.0), (1.0, 2.0)], "a double, b double", S.safe_ratio(F.col("a"), F.col("b"))) == [0.0, 0.5]
    assert one(spark, [(0.0,), (1.0,), (2.0,)], "x double", S.interpolate(F.col("x"), [(1.0, 0.3)])) == [0.0, 0.5, 1.0]
