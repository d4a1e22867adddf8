import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from flowlens.llm import token_files

FILE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("n", [0, 1, 4096, 8200])
def test_round_trip(n):
    rng = np.random.default_rng(n)
    for ids in (rng.integers(0, 50257, n), rng.zipf(1.3, n) % 50257, np.full(n, 7), rng.integers(0, 1 << 32, n)):
        ids = ids.astype(np.uint32)
        data = token_files.pack(np.array([5]), np.array([n]), ids)
        docs, counts, got = token_files.unpack(data)
        assert docs.tolist() == [5] and counts.tolist() == [n] and (got == ids).all()
    assert n < 8200 or len(token_files.pack(np.array([5]), np.array([n]), np.full(n, 7, np.uint32))) < n / 8


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_blocks_are_smaller_than_deflated_ones(spark, sf):
    texts = [r["text"] or "" for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").orderBy("doc_id").select("text").collect()]
    ids, _ = token_files.Encoder(FILE)(texts)
    blocks = [ids[at : at + token_files.BLOCK_IDS].astype("<u2").tobytes() for at in range(0, len(ids), token_files.BLOCK_IDS)]
    data = token_files.encode_blocks(ids)
    assert (token_files.decode_blocks(data) == ids).all()
    assert len(data) < 0.9 * sum(len(zlib.compress(b, 9)) for b in blocks)
    # over all ids at once, which blocks that are reset can't be
    assert len(data) < len(zlib.compress(b"".join(blocks), 9))


def test_damage_is_found():
    ids = np.arange(9000, dtype=np.uint32)
    data = bytearray(token_files.pack(np.array([5]), np.array([9000]), ids))
    data[-100] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        token_files.unpack(bytes(data))


def test_pieces_are_the_tokenizers():
    encode, whole = token_files.Encoder(FILE), Tokenizer.from_file(FILE)
    texts = [f"a{c}b {c}{c}1 {c}\n{c} '{c}s{c}2" for c in map(chr, range(0x540))] + ["<|endoftext|>x", "日本 語 x", "", "  a\n\n b_c __ d²3"]
    ids, counts = encode(texts)
    for t, row in zip(texts, np.split(ids, np.cumsum(counts)[:-1]), strict=True):
        assert row.tolist() == whole.encode(t, add_special_tokens=False).ids, repr(t)


def brute(docs):
    whole, start, out = Tokenizer.from_file(FILE), 0, {}
    for i, t in sorted(docs):
        ids = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        out[i] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    return out


def result(df):
    return {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_files.stored(df, FILE).collect()}


def test_whole_table(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet").repartition(3)
    assert result(df) == brute([(r["doc_id"], r["text"]) for r in df.collect()])


def test_repeated_ids(spark):
    df = spark.createDataFrame([(1, "b c"), (2, "x"), (1, "a"), (2, "x")], "doc_id long, text string")
    rows = token_files.stored(df, FILE, ids=True).orderBy("start").collect()
    whole = Tokenizer.from_file(FILE)
    assert [(r["doc_id"], whole.decode(r["ids"][:-1]), r["ids"][-1]) for r in rows] == [(1, "a", 2), (1, "b c", 2), (2, "x", 2), (2, "x", 2)]
    assert [r["start"] for r in rows] == [0, *np.cumsum([r["n_tokens"] for r in rows])[:-1]]


def test_files_are_read_by_a_task_each(spark, tmp_path):
    rows = []
    for part in range(6):
        ids = np.arange(part, part + 10, dtype=np.uint32)
        (tmp_path / f"{part}.tok").write_bytes(token_files.pack(np.array([part]), np.array([10]), ids))
        rows.append((part, 0, str(tmp_path / f"{part}.tok"), 10))
    manifest = spark.createDataFrame(rows, "part int, seq int, file string, n_ids long")
    got = token_files.read_files(manifest, f"file://{tmp_path}").withColumn("task", F.spark_partition_id()).collect()
    assert [(r["doc_id"], r["start"], r["n_tokens"]) for r in sorted(got)] == [(i, 10 * i, 10) for i in range(6)]
    assert len({r["task"] for r in got}) == 6


def test_edges(spark):
    docs = [(7, None), (3, ""), (None, "x"), (-1, "a b " * 30000)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert result(df) == brute([d for d in docs if d[0] is not None])
    clashing = df.withColumns({"start": F.lit("x"), "ids": F.lit(1), "part": F.lit(None), "seq": F.lit(2.5)})
    assert result(clashing) == result(df)
    assert token_files.stored(df.limit(0), FILE).count() == 0
    assert token_files.stored(df.where("text is null and doc_id = 0"), FILE).count() == 0
    assert token_files.stored(df, FILE, ids=True).where("doc_id = 7").first()["ids"] == [2]
