"""A corpus pipeline: toxic documents go, near-duplicates go, personal data is masked, domains are mixed, texts become ids.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept and returns a DataFrame; all but the
last return the columns of ``documents``. ``run`` writes each stage's result as Parquet in the shared folder and
reads it as the next one's docs. A document that the stages keep is whole but for what the third masks. The mix keeps every
document at least once: rates start at 1 and the shares are reached by repeating documents of the domains that need more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.llm import jaccard, mixing, pieces, pii, toxicity
from flowlens.llm.common import written

#: the share that documents of poor quality keep of the expected tokens, relative to their present one
POOR = 0.8


def labels_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.accepted(docs, labels_of(spark, sf_dir))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each(docs)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def mixed_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Poor documents fall to POOR of their share; the budget grows so that no rate has to fall below 1."""
    rows, domains = mixing.posteriors(docs, mixing.domains_of(labels_of(spark, sf_dir)))
    sums = rows.agg(*[F.sum(F.col("n_tokens") * F.get("p", d)) for d in range(len(domains))]).first()
    present = [float(x or 0) for x in sums]
    wanted = [x * (POOR if d == "poor" else 1.0) for x, d in zip(present, domains, strict=True)]
    growth = max((x / w for x, w in zip(present, wanted, strict=True) if w), default=1.0)
    rated, _ = mixing.rates(rows, [w * growth for w in wanted], floor=1.0)
    return mixing.repeated_to_rates(docs, rated)


def as_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pieces.token_rows(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", without_toxic),
    ("ngram_jaccard", without_near_copies),
    ("pii", without_personal_data),
    ("mixing", mixed_to_weights),
    ("sentencepiece", as_ids),
]
#: the stages have models and trees that SQL can't express
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
