import corpus_pipeline
from flowlens.llm import pii, toxicity
from tests.llm.test_jaccard import brute as components


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    one = corpus_pipeline.without_toxic(spark, docs, sf)
    bad = {r["doc_id"] for r in toxicity.scored(docs, labels).where("predicted = 1").collect()}
    kept = {r["doc_id"]: r["text"] for r in one.collect()}
    assert one.columns == names and set(kept) == {r["doc_id"] for r in docs.collect()} - bad
    two = corpus_pipeline.without_near_copies(spark, one, sf)
    want = components(list(kept.items()))
    assert {r["doc_id"] for r in two.collect()} == {i for i, (_, c) in want.items() if i == c}
    three = corpus_pipeline.without_personal_data(spark, two, sf)
    assert three.columns == names and three.count() == two.count()
    assert pii.report(three).where("n_email + n_ip + n_card + n_phone > 0").count() == 0
    four = corpus_pipeline.mixed_to_weights(spark, three, sf)
    assert four.columns == names and {r["doc_id"] for r in four.collect()} == {r["doc_id"] for r in three.collect()} and four.count() >= three.count()
    five = corpus_pipeline.as_ids(spark, four, sf)
    assert five.count() == four.count() and five.where("not round_trip").count() == 0


def test_run(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.count() > 0 and "ids" in out.columns
