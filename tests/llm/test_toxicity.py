import numpy as np

from flowlens.llm import toxicity


def test_index_is_exact():
    rng = np.random.default_rng(1)
    vectors = []
    for _ in range(500):
        t = np.sort(rng.choice(40, rng.integers(0, 6), replace=False))
        w = rng.integers(1, 4, len(t)).astype(float)
        vectors.append((t, w / max(1e-9, np.sqrt(w @ w))))
    ids = rng.permutation(500)
    index = toxicity.Index.build(ids, np.zeros(500), vectors, 40)
    dense = np.zeros((500, 40))
    for i, (t, w) in enumerate(vectors):
        dense[i, t] = w
    for t, w in vectors[:200]:
        q = np.zeros(40)
        q[t] = w
        cosine = np.round(dense @ q, 12)
        want = np.sort(cosine[cosine > 0])[::-1][:10]
        entries, got = index.nearest(t, w, 10)
        place = {int(i): r for r, i in enumerate(ids)}
        assert np.allclose(got, want) and len(set(entries)) == len(want)
        assert np.allclose([cosine[place[int(i)]] for i in index.ids[entries]], got)


def test_isotonic():
    x, y = toxicity.isotonic(np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1]))
    assert y.tolist() == [0, 0.5, 1] and x.tolist() == [1, 2.5, 4]
    x, y = toxicity.isotonic(np.ones(4), np.array([0.0, 0, 0, 1]))
    assert np.interp(1.0, x, y) == 0.25


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    got = toxicity.scored(spark.read.parquet(f"{d}/documents.parquet"), labels).join(labels, "doc_id").where("held_out").toPandas()
    rank, y = got.score.rank(), got.toxic == 1
    auc = (rank[y].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (~y).sum())
    assert auc > 0.95
    assert got.predicted[y].mean() > 0.85 and got.predicted[~y].mean() < 0.05


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 0.5), (2, "", 0.1), (None, "x", 0.2), (3, "stupid " * 50000, 0.3), (3, "stupid " * 50000, 0.3)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, None), (None, 1), (2, 1), (2, 0)], "doc_id long, toxic int")
    got = toxicity.scored(docs, labels).collect()
    assert len(got) == 4 and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.scored(docs.limit(0), labels).count() == 0
    assert toxicity.scored(docs, labels.limit(0)).count() == 4
    assert toxicity.accepted(docs, labels.limit(0)).columns == docs.columns


def test_terms_lean_both_ways_at_any_rate(spark):
    # half of the examples are toxic, so that no term can triple the rate
    rows = [(i, f"bad{i % 3} w{i}" if i % 2 else f"kind{i % 3} w{i}", i % 2) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, y int")
    want = {f"{w}{i}" for w in ("bad", "kind") for i in range(3)}
    assert set(toxicity.telling_terms(docs.select("text", "y"))) == want
    got = {r["doc_id"]: r for r in toxicity.scored(docs, docs.selectExpr("doc_id", "y toxic")).collect()}
    assert all(r["evidence"] and r["predicted"] == i % 2 for i, r in got.items())
    assert {r["doc_id"] for r in toxicity.accepted(docs, docs.selectExpr("doc_id", "y toxic")).collect()} == set(range(0, 400, 2))


def test_terms_have_no_cap(spark):
    many = " ".join(f"t{i}" for i in range(3000))
    docs = spark.createDataFrame([(many if i % 8 == 0 else f"w{i}", int(i % 8 == 0)) for i in range(160)], "text string, y int")
    assert len(toxicity.telling_terms(docs)) == 3000
