import hashlib
import itertools
import random
import re
import zlib
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from flowlens.llm import turns

SCHEMA = "conv_id long, turn long, role string, text string"
REAL = re.compile(r"[^\x20\x09-\x0D]")


def after_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        act = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if act:
            text = "" if act == 1 else re.sub("[.!?]", "", text) if act == 2 else text
            out += [(conv, turn, "user" if act == 4 else role, text)] * (2 if act == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))


def plain(all_rows, conv):
    """By every edit at every turn, with the grammar as an automaton."""
    rows = [r[1:] for r in after_damage(all_rows) if r[0] == conv]
    faults, seen = [], set()
    for _, role, text in rows:
        real = REAL.findall(text)
        faults.append("blank" if not real else "duplicate" if (role, text) in seen else "truncated" if real[-1] not in ".!?" else "")
        seen.add((role, text))
    follows = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    @lru_cache(None)
    def best(i, state, inserted):
        ways = [(0, "", ())] if i == len(rows) and state in ("", "a") else []
        steps = []
        if i < len(rows):
            _, role, text = rows[i]
            steps.append((4, "D", i + 1, state, 0, ()))
            extra = 3 * (faults[i] == "truncated")
            if faults[i] in ("", "truncated"):
                if (state, role[:1]) in follows:
                    steps.append((extra, "K", i + 1, role[:1], 0, ((role, text),)))
                steps += [(3 + extra, "R", i + 1, r[0], 0, ((r, text),)) for r in ("user", "assistant") if (state, r[0]) in follows]
        if inserted < 3:
            steps += [(3, "I", i, r[0], inserted + 1, ((r, ""),)) for r in ("user", "assistant") if (state, r[0]) in follows]
        for cost, letter, *to, said in steps:
            more = best(*to)
            if more:
                ways.append((cost + more[0], letter + more[1], (*said, *more[2])))
        return min(ways, default=None)

    cost, audit, said = best(0, "", 0)
    known = [t for t, *_ in rows if t is not None]
    initials = [role[:1] for _, role, _ in rows]
    return (
        conv, max(known) - min(known) + 1 - len(set(known)) if known else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
        sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials)), cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in said).encode()).hexdigest(),
    )


def some(seed, conversations, longest):
    rng = random.Random(seed)
    roles = ["user", "assistant"] * 4 + ["system", "tool", "", None, "s"]
    texts = ["a.", "b!", "c", "", " \t\n", None, "dé?  ", "x. y", ".\x0b", "e…"]
    rows = []
    for c in range(conversations):
        for t in range(rng.randint(0, longest)):
            rows.append((None if c == 3 else c, rng.choice([t, t, t, None, t + 2]), roles[t % 2] if rng.random() < 0.5 else rng.choice(roles), rng.choice(texts) if rng.random() < 0.4 else f"{t}."))
    return rows


@pytest.mark.parametrize(("seed", "conversations", "longest", "piece", "parts"), [(1, 60, 9, 32, "4"), (2, 40, 14, 3, "4"), (3, 30, 20, 1, "3"), (4, 3, 60, 7, "16")])
def test_same_as_brute_force(spark, seed, conversations, longest, piece, parts):
    rows = some(seed, conversations, longest)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("kind", F.lit("x")).withColumn("copies", F.lit(9))
    want = [plain(rows, c) for c in {r[0] for r in rows}]
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = [tuple(r) for r in turns.damaged_and_repaired(df, piece=piece).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(got, key=str) == sorted(want, key=str)


def test_repaired_turns_and_unseen_cases(spark):
    rows = [(1, 0, "assistant", "hi."), (1, 1, "system", "be good."), (1, 2, "user", "again"), (2, 0, "user", "")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted(tuple(r) for r in turns.repaired(df, df.withColumn("copies", F.lit(1))).collect())
    # deleting the first turn, keeping a truncated one and inserting an answer costs 10; insert, keep and two deletions cost 11
    assert got == [(1, 1, "system", "be good.", "K"), (1, 2, "user", "again", "K"), (1, 3, "assistant", "", "I")]


def test_one_long_conversation_of_equal_rows(spark):
    df = spark.range(3).select(F.lit(7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.lit("Yes.").alias("text"))
    got = turns.repair_report(df, df.withColumn("copies", F.lit(5000).cast("long"))).first()
    assert (got["duplicate"], got["illegal"], len(got["audit"]), got["cost"]) == (14_999, 14_999, 15_001, 4 * 14_999 + 3)
    assert got["audit"] == "K" + "D" * 14_999 + "I"
