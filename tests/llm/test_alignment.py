import hashlib
from collections import Counter

import public_tokenizers
from pyspark.sql import functions as F

from flowlens.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def spans(parts):
    out, at = [], 0
    for i, p in parts:
        out.append((at, at := at + len(p), i))
    return out


def plain(rows):
    """Whole texts through the libraries, every token against every token of its group."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(x): x for x in printable} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in printable)}
    docs = []
    for doc_id, text in rows:
        groups = []
        if text:
            a_parts = [(i, bytes(letters[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
            b_parts = [(i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()) for i in b.encode(text) for p in [b.id_to_piece(i)]]
            if b"".join(p for _, p in a_parts) == b"".join(p for _, p in b_parts) == (" " + text).encode():
                a_spans, b_spans = spans(a_parts), spans(b_parts)
                start = 0
                for end in sorted({e for _, e, _ in a_spans} & {e for _, e, _ in b_spans}):
                    groups.append(([i for s, e, i in a_spans if start <= s and e <= end], [i for s, e, i in b_spans if start <= s and e <= end]))
                    start = end
        docs.append((doc_id, groups, Counter((x, y) for g in groups for x in g[0] for y in g[1])))
    count = Counter(p for _, _, links in docs for p in links)
    top = {}
    for (x, _), n in count.items():
        top[x] = max(top.get(x, 0), n)
    out = []
    for doc_id, groups, links in docs:
        digest = hashlib.sha256(";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups).encode()).hexdigest() if groups else ""
        best = sum(n for p, n in links.items() if count[p] == top[p[0]])
        out.append((doc_id, sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), sum(links.values()), best, sum(n * count[p] for p, n in links.items()), digest))
    return sorted(out), sorted((x, y, n, n == top[x]) for (x, y), n in count.items())


ODD = [
    (1, None), (2, ""), (3, " "), (4, "a▁b"), (5, "<|endoftext|> <s>x</s> <0x41>"), (6, "    x　 y   z\u0085 w"), (7, "tab\t  two  \n \n spaces   end  "), (8, "é ü日本 語 emoji 👩‍👩 …  “q” ’s don't"),
    (9, "x" * 3000 + " " * 700 + "abcabc" * 400), (9, "same id"), (10, "same id"), (None, "no id"), (11, "\x00\x01 \x7f￾"), (12, "1234567890 12,5 ½ ²³"), (13, "  ogham   mid   thin"), (14, "  lead"), (15, "Привет мир, как дела"),
]


def check(spark, rows, **more):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("codes", F.lit(1)).withColumn("pair", F.lit("x")).repartition(3)
    docs, pairs = alignment.aligned(df, A, B, **more)
    want_docs, want_pairs = plain([r for r in rows if r[0] is not None])
    assert sorted(tuple(r) for r in docs.collect()) == want_docs
    assert sorted(tuple(r) for r in pairs.collect()) == want_pairs


def test_odd_texts(spark):
    check(spark, ODD)
    check(spark, ODD * 3, block_bytes=100)


def test_links_expanded_in_steps(spark, monkeypatch):
    # groups and links of a text that repeats itself, some thousands of links at a time
    import numpy as np

    rng = np.random.default_rng(1)
    a_group, b_group = np.sort(rng.integers(0, 9, 300)), np.sort(rng.integers(0, 9, 400))
    a_group[:9], b_group[:9] = 0, 0
    a_group, b_group = np.sort(np.r_[a_group, np.arange(9)]), np.sort(np.r_[b_group, np.arange(9)])
    a, b = rng.integers(0, 7, len(a_group)), rng.integers(0, 11, len(b_group))
    doc = np.array([0, 0, 0, 1, 1, 2, 2, 2, 3])
    whole = alignment.linked(a_group, a, b_group, b, doc, 7, 11)
    monkeypatch.setattr(alignment, "LINKS", 50)
    monkeypatch.setattr(alignment, "WIDE", 8)
    steps = alignment.linked(a_group, a, b_group, b, doc, 7, 11)
    want = Counter((int(doc[g]) * 7 + int(x)) * 11 + int(y) for g, x in zip(a_group, a, strict=True) for h, y in zip(b_group, b, strict=True) if g == h)
    for key, weight in (whole, steps):
        assert dict(zip(key.tolist(), weight.tolist(), strict=True)) == want and (np.diff(key) > 0).all()


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = sorted(tuple(r) for r in alignment.aligned(docs, A, B, block_bytes=20_000)[0].collect())
    assert got == plain([(r["doc_id"], r["text"]) for r in docs.collect()])[0]


def test_empty_table(spark):
    docs, pairs = alignment.aligned(spark.createDataFrame([], "doc_id long, text string"), A, B)
    assert docs.count() == 0 == pairs.count()
    docs, _ = alignment.aligned(spark.createDataFrame([(5, None)], "doc_id long, text string"), A, B)
    assert [tuple(r) for r in docs.collect()] == [(5, 0, 0, 0, 0, 0, 0, "")]


def test_texts_that_end_in_one_space(spark):
    check(spark, [(1, "abc "), (2, "one two "), (3, "é "), (4, "<s> "), (5, "abc  "), (6, "a \n "), (7, "▁ "), (8, " "), (9, "abc")])
