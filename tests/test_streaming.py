import random

import pytest
from pyspark.sql import functions as F

from flowlens.operators import correlate as C
from flowlens.operators import flows as W
from flowlens.streaming import commits
from flowlens.streaming.flows import stream_flows

PACKETS = "source_id string, key string, seq long, micros long, end boolean"


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(name)


def packets(seed, n=400, captures=3):
    rng, rows = random.Random(seed), []
    for c in range(captures):
        t = 1000.0
        for i in range(n):
            t += rng.choice([0, 1, 5, 40])
            late = rng.choice([5, 70, 350]) if rng.random() < 0.15 else 0
            rows.append((f"c{c}", f"k{rng.randrange(6)}", i, round((t - late) * 1e6), False))
        rows.append((f"c{c}", None, n, None, True))
    return rows


def ended(spark, rows, folder, parts, name, **more):
    """The stream's flows, the rows given in so many files, one file a batch."""
    step = -(-max(r[2] + 1 for r in rows) // parts)
    for i in range(parts):
        part = [r for r in rows if i * step <= r[2] < (i + 1) * step]
        if part:
            spark.createDataFrame(part, PACKETS).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    source = spark.readStream.schema(PACKETS).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    q = stream_flows(source, 60, 300, 4, **more).writeStream.format("memory").queryName(name).option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start()
    q.awaitTermination(300)
    return spark.table(name).collect()


@pytest.mark.parametrize("parts", [1, 4])
def test_stream_equals_the_fold_and_loses_no_packet(rocks, tmp_path, parts):
    rows = packets(parts)
    got = ended(rocks, rows, tmp_path, parts, f"flows{parts}")
    df = rocks.createDataFrame([r[:4] for r in rows if not r[4]], "source_id string, key string, seq long, micros long")
    batch = W.segment_out_of_order(df, 60, 300, 4).groupBy("source_id", "key", "segment", "reason").agg(F.min("micros").alias("a"), F.max("micros").alias("b"), F.count("seq").alias("n"))
    want = {(r["source_id"], r["key"], r["segment"], r["a"], r["b"], r["n"], r["reason"]) for r in batch.collect()}
    assert {(r["source_id"], r["key"], r["segment"], r["first"], r["last"], r["packets"], r["reason"]) for r in got} == want and len(got) == len(want)
    late = 0
    for c in {r[0] for r in rows}:
        newest = None
        for r in rows:
            if r[0] == c and not r[4]:
                late += newest is not None and r[3] < newest
                newest = r[3] if newest is None else max(newest, r[3])
    assert sum(r["packets"] for r in got) == 1200 and sum(r["late"] for r in got) == late > 100
    assert {r["reason"] for r in got} == {"active_timeout", "idle_timeout", "capacity", "capture_end"}


def scored(df):
    return df.select(F.concat_ws("#", "source_id", "key", "segment").alias("flow_id"), (F.col("packets") / 9).alias("risk"))


def raised(found, _):
    return found.where("risk >= 0.5").select("flow_id", F.lit("alert").alias("kind"))


FLOWS = "source_id string, key string, segment long, first long, last long, packets long, late long, reason string"


def flow_files(spark, folder, n=3):
    for i in range(n):
        spark.createDataFrame([("c", f"k{j}", i, 0, 1, j, 1, "idle_timeout") for j in range(1, 9)], FLOWS).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return spark.readStream.schema(FLOWS).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def test_a_batch_is_seen_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    source, root, cp = flow_files(spark, tmp_path), f"{tmp_path}/store", f"{tmp_path}/cp"
    calls, digest = [], commits.content_digest

    def dies(df):
        # between the writes of the second batch's detections and its alerts
        calls.append(df.columns)
        if len(calls) == 4:
            raise RuntimeError("killed")
        return digest(df)

    monkeypatch.setattr(commits, "content_digest", dies)
    with pytest.raises(Exception, match="killed"):
        commits.score_in_batches(source, root, cp, scored, raised).awaitTermination(120)
    seen = lambda name, schema: commits.committed(spark, root, name, schema)
    assert commits.batches_of(spark, root) == [0] and seen("detections", "flow_id string, risk double").count() == 8 and seen("alerts", "flow_id string, kind string").count() == 4
    monkeypatch.setattr(commits, "content_digest", digest)
    commits.score_in_batches(source, root, cp, scored, raised).awaitTermination(120)
    assert commits.batches_of(spark, root) == [0, 1, 2]
    found = seen("detections", "flow_id string, risk double")
    assert found.count() == 24 == found.select("flow_id").distinct().count() and seen("alerts", "flow_id string, kind string").count() == 12
    assert {r["name"]: r["n"] for r in commits.progress(spark, root).collect()} == {"detections": 24, "alerts": 12, "counter:flows": 24, "counter:late_packets": 24}


def test_replay_is_reused_and_other_rows_conflict(spark, tmp_path):
    root, a = str(tmp_path), spark.createDataFrame([(1, "x"), (2, None)], "id long, v string")
    assert commits.commit_batch(spark, root, 7, {"t": a}) == "created"
    assert commits.commit_batch(spark, root, 7, {"t": a.orderBy(F.desc("id")).repartition(3)}) == "reused"
    for other in (a.limit(1), a.union(a.limit(1)), a.withColumn("v", F.lit("x"))):
        with pytest.raises(commits.BatchConflict):
            commits.commit_batch(spark, root, 7, {"t": other})
    assert commits.committed(spark, root, "t", "id long, v string").count() == 2
    assert not list((tmp_path / "staging").iterdir())


def alerts(spark, seed, n=90):
    rng, rows = random.Random(seed), []
    for i in range(n):
        start = rng.randrange(2000) * 1_000_000
        rows.append((f"{'9' * 14}-{i}", f"10.0.0.{rng.randrange(5)}", f"10.1.0.{rng.randrange(4)}", start, start + rng.randrange(60) * 1_000_000, rng.random(), "multi_engine_suspicion" if i % 3 else "behavioral_pattern", rng.choice(["AUTH_FAILURE", "OTHER"]), rng.choice([None, None, "false_positive"])))
    return rows


@pytest.mark.parametrize("seed", [1])
def test_incremental_groups_equal_those_of_all_alerts(spark, tmp_path, seed):
    rows = alerts(spark, seed)
    random.Random(seed + 10).shuffle(rows)
    names = ["members", "entities", "rules", "alerts", "codes", "first_seen", "last_seen", "severity"]
    plain = lambda df: sorted(((tuple(map(str, r)), round(r["score"], 6)) for r in df.select(*names, "score").collect()), key=str)
    seen = []
    for batch, (a, b) in enumerate([(0, 50), (45, 70), (70, 90)]):
        out = commits.correlate_batch(spark, str(tmp_path), batch, spark.createDataFrame(rows[a:b], commits.FACTS), 300.0)
        seen.append({r["outcome"] for r in out.collect()})
        assert plain(commits.current_groups(spark, str(tmp_path))) == plain(C.alert_groups(spark.createDataFrame(rows[:b], commits.FACTS), 300.0))
    assert seen[0] == {"created"} and {"created", "retired"} <= set().union(*seen[1:])
    again = commits.correlate_batch(spark, str(tmp_path), 2, spark.createDataFrame(rows[70:], commits.FACTS), 300.0)
    assert {r["outcome"] for r in again.collect()} == seen[2] and commits.batches_of(spark, str(tmp_path)) == [0, 1, 2]


def test_members_keep_long_ids_apart(spark):
    rows = [(1234567890123451 + i, "10.0.0.1", "10.0.0.2", i * 1000, i * 1000 + 1, 0.9, "behavioral_pattern", "AUTH", None) for i in range(3)]
    got = C.alert_groups(spark.createDataFrame(rows, commits.FACTS.replace("alert_id string", "alert_id long")), 60.0).collect()
    assert [r["members"] for r in got] == [["1234567890123451", "1234567890123452", "1234567890123453"]] and len(got[0]["entities"]) == 3
