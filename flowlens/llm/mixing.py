"""Mixing sources to target weights by soft membership.

A classifier fitted on the labelled table gives every document a posterior over the domains; a distributed
projected least squares then finds nonnegative rates r (how often a document is used on average) for which
the expected tokens of each domain, sum of r * tokens * posterior, match the targets. Everything runs as
DataFrame functions and Spark ML; what comes to the driver are sums over domains.
"""

from __future__ import annotations

import logging

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import written

#: labelled documents that the classifier is fitted on, at most
SAMPLE = 4000
FEATURES = 1 << 12
#: what a rate's distance from 1 costs beside the squared miss
RIDGE = 1e-7
#: far beyond what the search takes; the miss is reported either way
ROUNDS = 200
CLOSE = 1e-6
#: slope of the dual that counts as none
FLAT = 1e-10


def tokens_of(text: Column) -> Column:
    """The words of a text between spaces, tabs and line ends."""
    return F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def posteriors(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", domain_col: str = "domain", sample: int = SAMPLE) -> tuple[DataFrame, list[str]]:
    """(doc_id, mark, n_tokens, p array<double>) of every document with an id, and the domains in the order of p.

    labels is (id, domain); rows without an id or domain are no examples, and of several rows for an id the smallest
    domain counts. With fewer than two domains every document belongs to the one there is, or to "all".
    mark is a hash of the text, so that rows which repeat an id stay apart.
    """
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).where("doc_id is not null")
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(domain_col).cast("string").alias("domain")).where("doc_id is not null and domain is not null").groupBy("doc_id").agg(F.min("domain").alias("domain"))
    chosen = written(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample), "mix-examples")
    words = docs.select("doc_id", F.xxhash64("text").alias("mark"), tokens_of(F.col("text")).alias("words"))
    vectors = HashingTF(inputCol="words", outputCol="features", numFeatures=FEATURES, binary=True).transform(words)
    examples = written(vectors.join(F.broadcast(chosen), "doc_id").select("features", "domain"), "mix-fit")
    # as many rows as domains
    domains = [r["domain"] for r in examples.groupBy("domain").count().where("count >= 5").orderBy("domain").collect()]
    sized = vectors.withColumn("n_tokens", F.size("words").cast("long"))
    if len(domains) < 2:
        return written(sized.select("doc_id", "mark", "n_tokens", F.array(F.lit(1.0)).alias("p")), "posteriors"), domains or ["all"]
    number = F.element_at(F.create_map(*[x for i, d in enumerate(domains) for x in (F.lit(d), F.lit(float(i)))]), F.col("domain"))
    train = examples.where(F.col("domain").isin(domains)).withColumn("y", number).coalesce(2)
    model = LogisticRegression(labelCol="y", maxIter=25, regParam=0.02, family="multinomial").fit(train)
    scored = model.transform(sized).select("doc_id", "mark", "n_tokens", vector_to_array("probability").alias("p"))
    return written(scored, "posteriors"), domains


def rate_column(u: np.ndarray, floor: float) -> Column:
    """The step from 1 along the posteriors that u gives, projected back to at least the floor."""
    slope = sum((F.get(F.col("p"), d) * float(v) for d, v in enumerate(u)), F.lit(0.0))
    return F.greatest(F.lit(float(floor)), 1.0 - slope)


def rates(rows: DataFrame, targets: list[float], ridge: float = RIDGE, rounds: int = ROUNDS, close: float = CLOSE, floor: float = 0.0) -> tuple[DataFrame, np.ndarray]:
    """rows (n_tokens, p) with the column rate, and the expected tokens of each domain under it.

    Minimises the sum over d of (expected_d - target_d)^2, relative to the targets' sum, plus ``ridge`` times the mean of (rate - 1)^2
    by tokens, over rates of at least ``floor``. At the minimum, the projected gradient is nought where each rate is
    max(floor, 1 - p . u) with u = miss / ridge, so the search is for u, of one number a domain: Newton steps on the
    convex dual, halved until they lower it. A step needs sums over all documents, of which there are as many as pairs
    of domains, and nothing is written between rounds. It ends when every miss is within ``close`` of the
    targets' sum or at the minimum (targets out of reach); ``rounds`` only guards the loop.
    """
    size = len(targets)
    goal = np.array(targets, float)
    scale = float(goal.sum())
    n, p = F.col("n_tokens").cast("double"), [F.get(F.col("p"), d) for d in range(size)]

    def at(u: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray] | None:
        """The dual at u, its gradient and curvature, and the expected tokens."""
        now = rows.select("n_tokens", "p", rate_column(u, floor).alias("r"))
        slope = sum((x * float(v) for x, v in zip(p, u, strict=True)), F.lit(0.0))
        r, free = F.col("r"), F.when(F.col("r") > floor, n).otherwise(0.0)
        sums = now.agg(F.sum(n * ((r - 1) * (r - 1) / 2 + r * slope)), *[F.sum(n * x * r) for x in p], *[F.sum(free * x * y) for x in p for y in p]).first()
        if sums[0] is None:
            return None
        sums = np.array(sums, float)
        expected = sums[1 : 1 + size]
        value = (float(u @ goal) - sums[0]) / scale + ridge / 2 * float(u @ u)
        return value, (goal - expected) / scale + ridge * u, sums[1 + size :].reshape(size, size) / scale + ridge * np.eye(size), expected

    u = np.zeros(size)
    here = at(u) if scale else None
    if here is None:
        return rows.withColumn("rate", rate_column(u, floor)), u
    for _ in range(rounds):
        value, gradient, curve, expected = here
        if np.abs(expected - goal).max() <= close * scale or np.abs(gradient).max() <= FLAT:
            break
        step = -np.linalg.solve(curve, gradient)
        fall, share = float(gradient @ step), 1.0
        there = at(u + step)
        # where the fall is below what the sums can show, the slope decides
        lower = lambda new: np.abs(new[1]).max() < np.abs(gradient).max() if -fall * share < 1e-13 * (1 + abs(value)) else new[0] <= value + 1e-4 * share * fall  # noqa: B023, E731
        while not lower(there) and share > 1e-9:
            share /= 2
            there = at(u + share * step)
        if not lower(there):
            break
        u, here = u + share * step, there
    miss = np.abs(here[3] - goal).max() / scale
    if miss > close:
        logging.getLogger(__name__).warning("expected tokens miss the targets by up to %.3g of their sum", miss)
    return rows.withColumn("rate", rate_column(u, floor)), here[3]


def mixed(documents: DataFrame, labels: DataFrame, weights: dict[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text", domain_col: str = "domain", floor: float = 0.0, budget: float | None = None) -> DataFrame:
    """Per document: doc_id, mark, n_tokens, domain (the likeliest), posterior (its probability), rate, expected_tokens, miss.

    miss is by how much the expected tokens of that domain miss its target, as a share of the budget.
    weights are the domains' shares of the expected tokens (default: equal); domains without examples get none and
    the others share in proportion. budget is the sum of expected tokens (default: what there is). Null
    texts have no tokens; rows with a null id are left out; an empty table gives an empty result.
    """
    rows, domains = posteriors(documents, labels, id_col, text_col, domain_col)
    share = np.array([1.0 if weights is None else weights.get(d, 0.0) for d in domains])
    share = share / share.sum() if share.sum() else np.full(len(domains), 1 / len(domains))
    total = budget if budget is not None else float(rows.agg(F.sum("n_tokens")).first()[0] or 0)
    rated, expected = rates(rows, (share * total).tolist(), floor=floor)
    miss = (expected - share * total) / (total or 1.0)
    best = F.array_max("p")
    name = F.element_at(F.array(*[F.lit(d) for d in domains]), F.array_position("p", best).cast("int"))
    missed = F.element_at(F.array(*[F.lit(float(m)) for m in miss]), F.array_position("p", best).cast("int"))
    return rated.select("doc_id", "mark", "n_tokens", name.alias("domain"), best.alias("posterior"), "rate", (F.col("rate") * F.col("n_tokens")).alias("expected_tokens"), missed.alias("miss"))


def domains_of(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, domain) of the labelled table: good, poor or toxic."""
    kind = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor")
    return labels.select(id_col, kind.alias("domain"))


def repeated_to_rates(documents: DataFrame, rated: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 3) -> DataFrame:
    """The rows of documents, each as often as its rate says: the whole part, and once more with the rest's probability, drawn by a hash of the id.

    Rows without an id stay once. The columns are those of documents.
    """
    side = rated.select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"), F.col("rate").alias("_rate")).dropDuplicates(["_id", "_mark"])
    out = documents.withColumn("_m", F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    out = out.join(side, (F.col(id_col).cast("long") == F.col("_id")) & (F.col("_m") == F.col("_mark")), "left")
    draw = F.pmod(F.xxhash64(F.col(id_col).cast("long"), F.lit(seed)), F.lit(1_000_000)) / 1e6
    times = F.coalesce(F.floor("_rate") + (draw < F.col("_rate") - F.floor("_rate")).cast("long"), F.lit(1))
    return out.withColumn("_times", times).where("_times > 0").withColumn("_again", F.explode(F.sequence(F.lit(1), F.col("_times")))).select(*documents.columns)
