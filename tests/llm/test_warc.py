import gzip
import hashlib
import os

from pyspark.sql import functions as F

from flowlens.llm import warc
from flowlens.llm.common import new_path


def brute(rows):
    first = {}
    for i, _, h in rows:
        b = (h or "").encode()
        if len(b) >= 100 and i is not None:
            first[b] = min(i, first.get(b, i))
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        f = first.get(b)
        again = f is not None and f != i
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", f if again else None))
    return sorted(out, key=str)


ROWS = [(5, "u", "x" * 100), (3, "u", "x" * 100), (4, None, "x" * 99), (6, "v\r\nEvil: 1", "x" * 99), (7, "u", None), (8, "u", ""), (9, "u", "é\r\n\r\nWARC/1.1\r\n" * 30), (9, "u", "é\r\n\r\nWARC/1.1\r\n" * 30), (1, "u", "é\r\n\r\nWARC/1.1\r\n" * 30), (None, "u", "y" * 200), (10, "u", "z" * 300000)]


def test_round_trip(spark):
    df = spark.createDataFrame(ROWS, "page_id long, url string, html string").withColumn("first", F.lit(1))
    got = sorted([tuple(r) for r in warc.archived_pages(df).collect()], key=str)
    assert got == brute(ROWS)
    assert warc.archived_pages(df.limit(0)).count() == 0


def test_pushdown_and_columns(spark):
    df = spark.createDataFrame(ROWS, "page_id long, url string, html string")
    path = warc.write_archives(warc.with_revisits(df, "page_id", "url", "html"), new_path(spark, "warc"), roll_bytes=200)
    names = [n for n in os.listdir(path.removeprefix("file://")) if n.endswith(".warc.gz")]
    assert len(names) > 3
    # any gzip reader finds whole records
    text = b"".join(gzip.open(f"{path.removeprefix('file://')}/{n}").read() for n in names)
    assert text.count(b"WARC-Record-ID:") == len(ROWS)
    slim = warc.read_archives(spark, path, "record_id string, record_type string").where("record_type in ('revisit') and record_id = '<urn:page:9>'")
    assert [r["record_type"] for r in slim.collect()] == ["revisit"] * 2
    assert warc.read_archives(spark, path).where("payload_length > 1000").count() == 1


def test_other_writers_members(spark):
    path = new_path(spark, "warc")
    os.makedirs(path.removeprefix("file://"))
    record = warc.record_bytes({"record_id": "<a>", "record_type": "response", "payload": b"hello"})
    with open(path.removeprefix("file://") + "/x.warc.gz", "wb") as f:
        f.write(gzip.compress(record) + gzip.compress(record.replace(b"<a>", b"<b>")))
    got = warc.read_archives(spark, path).collect()
    assert [(r["record_id"], bytes(r["payload"])) for r in got] == [("<a>", b"hello"), ("<b>", b"hello")]
