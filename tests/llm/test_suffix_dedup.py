import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlens.llm import suffix_dedup


def brute(docs):
    had, out = set(), {}
    for i, t in sorted(docs):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            w = b[p : p + 100]
            if w in had:
                gone[p : p + 100] = b"\1" * 100
            else:
                had.add(w)
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


def result(df, often=suffix_dedup.OFTEN):
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.deduplicated(df, often=often).collect()}


def test_sorting():
    rng = np.random.default_rng(3)
    m = rng.integers(0, 2, (400, 100)).astype(np.uint8)
    m[:, :40] = m[0, :40]
    m[100:200] = m[rng.integers(0, 100, 100)]
    group = np.sort(rng.integers(0, 5, 400))
    order, common = suffix_dedup.deep_shallow(m, group, 2)
    assert order.tolist() == sorted(range(400), key=lambda i: (group[i], m[i].tobytes(), order.tolist().index(i)))
    for k in range(1, 400):
        a, b = m[order[k - 1]], m[order[k]]
        same = 100 if (a == b).all() else int((a != b).argmax())
        assert common[k] == (same if group[order[k]] == group[order[k - 1]] else -1)


def test_blind_trie():
    rng = random.Random(5)
    strings = [bytes(rng.choice(b"ab") for _ in range(9)) for _ in range(300)]
    assert [strings[i] for i in suffix_dedup.blind_trie(strings)] == sorted(strings)


def test_whole_table(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    want = brute([(r["doc_id"], r["text"]) for r in df.collect()])
    assert result(df) == want and sum(w[1] for w in want.values())


@pytest.mark.parametrize("often", [2, 32, 256])
def test_repeats(spark, often):
    rng = random.Random(often)
    line = "".join(rng.choice("abcdeé ") for _ in range(150))
    short = "".join(rng.choice("xyz ") for _ in range(70))
    docs = [(i, "".join(rng.choice([line, short, line[:99], line[20:130], "".join(rng.choice("abc ") for _ in range(rng.randrange(90)))]) for _ in range(rng.randrange(8)))) for i in range(120)]
    docs += [(200, "a" * 500), (201, "ab" * 300), (202, "a" * 99), (203, line), (204, line), (205, "a" * 700), (300, "é" * 4000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert result(df, often) == brute(docs)


def test_edges(spark):
    docs = [(1, None), (2, ""), (3, "x" * 99), (None, "y" * 300), (4, "z" * 100), (5, "z" * 100), (5, "z" * 100)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"s": F.lit(1), "h": F.lit("x")})
    assert result(df) == brute([d for d in docs if d[0] is not None][:-1])
    assert suffix_dedup.deduplicated(df, texts=True).count() == 6
    assert result(df.limit(0)) == {}
