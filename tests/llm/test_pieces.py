import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from flowlens.llm import pieces

FILE = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def model():
    return pieces.Model.load(FILE)


def brute(model, text):
    """Plain Viterbi over characters with a dictionary."""
    s = model.normal(text)
    table = {p: i for i, (p, k) in enumerate(zip(model.pieces, model.kinds)) if k in (pieces.NORMAL, pieces.USER)}
    best = [(0.0, None, None)] + [(float("-inf"), None, None)] * len(s)
    for e in range(1, len(s) + 1):
        for b in range(max(0, e - 20), e):
            i = table.get(s[b:e], -1 if e - b == 1 else None)
            if i is not None:
                total = best[b][0] + (model.unknown if i < 0 else model.scores[i])
                if total > best[e][0]:
                    best[e] = (total, b, i)
    out, e = [], len(s)
    while e:
        _, b, i = best[e]
        out[:0] = [i] if i >= 0 else [int(model.byte_ids[c]) for c in s[b:e].encode()]
        e = b
    return out


def test_model_file(model):
    sp = sentencepiece.SentencePieceProcessor(model_file=FILE)
    assert model.pieces == [sp.id_to_piece(i) for i in range(sp.vocab_size())]
    assert all(abs(model.scores[i] - sp.get_score(i)) < 1e-3 for i in range(0, 32000, 97))


def test_double_array():
    keys = {w.encode(): i for i, w in enumerate(["a", "ab", "abc", "b", "é", "zz", "ÿ"])}
    t = pieces.DoubleArray.build(keys)

    def get(w):
        s = 0
        for c in w:
            if t.check[t.base[s] + c] != s:
                return -1
            s = t.base[s] + c
        return t.value[s]

    assert all(get(k) == v for k, v in keys.items()) and get(b"z") == get(b"abd") == get(b"q") == -1


TEXTS = ["", " ", "hello  world", "a", "\n\t x", "é ü 日本語 𝔘𝔫 \u0001", "   lead", "trail   ", "x" * 3000, "word " * 20000, "▁a", "½ﬁ", "\x00b"]


def test_segments(model):
    encode, decode, sp = pieces.Encoder(model), pieces.Decoder(model), sentencepiece.SentencePieceProcessor(model_file=FILE)
    ids, counts = encode(TEXTS)
    at = 0
    for t, n in zip(TEXTS, counts):
        row = ids[at : at + n].tolist()
        at += n
        assert row == brute(model, t), t[:50]
        assert decode(row) == sp.decode(row)
        assert decode(row) == t or "▁" in t


def test_whole_table(spark, sf, model):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r["doc_id"]: r for r in pieces.token_rows(docs, FILE).collect()}
    rows = docs.collect()
    assert len(got) == len(rows) and all(r["round_trip"] for r in got.values())
    for r in rows[:25]:
        assert got[r["doc_id"]]["ids"] == brute(model, r["text"])
    back = pieces.decoded(pieces.token_rows(docs, FILE), model).join(docs.withColumnRenamed("text", "was"), "doc_id")
    assert back.where("text <> was").count() == 0


def test_edges(spark, model):
    df = spark.createDataFrame([(1, None), (None, "a b"), (1, ""), (1, "")], "doc_id long, text string").withColumn("ids", F.lit("x"))
    got = pieces.encoded(df, model).collect()
    assert len(got) == 4 and [r["ids"] for r in got if r["n_tokens"]] == [brute(model, "a b")] and sum(r["ids"] is None for r in got) == 1
    assert pieces.encoded(df.limit(0), model).count() == 0
