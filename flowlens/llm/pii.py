"""Personal data: high-recall generators propose spans, boosted trees score them, calibrated thresholds select.

Everything runs as DataFrame functions and Spark ML. Positions are code points, ends exclusive.

* Base rules name certain spans of four kinds (email, ip, card, phone); they always stay.
* Loose generators propose further, overlapping spans: spelled-out addresses and any run of digit groups.
* Boosted trees score a proposal from its format and the characters around it. They are fitted on at most
  ``FIT_ROWS`` proposals, shared out among the kinds. As no spans are labelled, those that a base rule confirms are right,
  and are shown again in forms that the base rules can't see: phones without their country, cards in dotted groups,
  spelled-out addresses. Wrong are proposals that can't be of their kind (a failed checksum, digits within a word, a date), and
  confirmed ones rewritten so that they aren't any more. The others have no label and are only scored.
* Per kind, the threshold is the lowest score above which at least ``PRECISION`` of all labelled proposals in the held-out
  quarter of the documents are right. A kind without such a score selects nothing beyond the base.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.llm.common import dropped, texts_of, written

KINDS = ("email", "ip", "card", "phone")
FIT_ROWS = 8000
PRECISION = 0.97

#: Each starts where a run of its first class starts, or where the match before ends, as a leftmost search does;
#: possessive repeats keep long runs linear.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
LOOSE_EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++(?:\x20?(?:\(dot\)|\[dot\])\x20?[A-Za-z0-9._%+-]++)*+\x20?(?:@|\(at\)|\[at\])\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?[A-Za-z0-9-]++)++"
LOOSE_DIGITS = r"[+(]?[0-9](?:[\x20().-]{0,2}[0-9])++"
SMALL_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
KEYWORDS = {"phone": r"(?i)(?:tel|phone|call|fax|mobile)\W*$", "card": r"(?i)(?:card|visa|pay)\W*$", "email": r"(?i)(?:mail|contact|write)\W*$", "ip": r"(?i)(?:ip|host|server|address)\W*$"}
FEATURES = ("digits", "length", "groups", "longest", "dots", "dashes", "spaces", "brackets", "plus", "at", "before", "after", "keyword", "luhn", "kind")


def digits_of(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the Luhn sum of a digit string is a multiple of ten."""
    doubled = lambda c, i: F.when(i % 2 == 0, c).otherwise(c * 2 - F.when(c > 4, 9).otherwise(0))
    values = F.transform(F.regexp_extract_all(F.reverse(digits), F.lit("[0-9]"), F.lit(0)), lambda c, i: doubled(c.cast("int"), i))
    return F.aggregate(values, F.lit(0), lambda a, x: a + x) % 10 == 0


def proposals(documents: DataFrame) -> DataFrame:
    """(doc_id, mark, kind, s, e, m, before, after, base) for every base or loose match in the texts of (doc_id, text).

    mark is a hash of the text, so that rows which repeat an id with another text stay apart.
    """
    has_digit, has_at = F.col("text").rlike("[0-9]"), F.col("text").contains("@") | F.col("text").contains("(at)") | F.col("text").contains("[at]")
    rules = {"email": (EMAIL, has_at), "ip": (IP, has_digit), "card": (CARD, has_digit), "phone": (PHONE, has_digit), "loose_email": (LOOSE_EMAIL, has_at), "loose_digits": (LOOSE_DIGITS, has_digit)}
    df = documents.select("doc_id", F.xxhash64("text").alias("mark"), "text").where(has_digit | has_at)
    none = F.array().cast("array<string>")
    # matches first; the parts between them only where there is a match
    df = df.withColumns({f"m_{r}": F.when(gate, F.regexp_extract_all("text", F.lit(p), F.lit(0))).otherwise(none) for r, (p, gate) in rules.items()})
    df = df.withColumns({f"p_{r}": F.when(F.size(f"m_{r}") > 0, F.split("text", p, -1)).otherwise(none) for r, (p, _) in rules.items()}).drop("text")

    def matched(r: str) -> Column:
        m, p = F.col(f"m_{r}"), F.col(f"p_{r}")
        each = lambda x, i: F.struct(F.lit(r).alias("rule"), i.alias("i"), F.length(F.get(p, i)).alias("gap"), x.alias("m"), F.right(F.get(p, i), F.lit(16)).alias("before"), F.left(F.get(p, i + 1), F.lit(4)).alias("after"))
        return F.transform(m, each)

    # a match starts after all the parts and matches before it; a window adds them up, for in a fold it would take time with the square of their number
    rows = df.withColumn("row", F.monotonically_increasing_id()).select("row", "doc_id", "mark", F.explode(F.concat(*[matched(r) for r in rules])).alias("x")).select("row", "doc_id", "mark", "x.*")
    e = F.sum(F.col("gap") + F.length("m")).over(Window.partitionBy("row", "rule").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)).cast("int")
    rows = rows.withColumn("e", e).withColumn("s", F.col("e") - F.length("m"))
    rows = rows.withColumn("d", digits_of(F.col("m"))).withColumn("n", F.length("d"))
    valid = (
        F.when(F.col("rule") == "email", F.lit(True))
        .when(F.col("rule") == "ip", F.col("m").rlike(rf"^{SMALL_PART}(?:\.{SMALL_PART}){{3}}$"))
        .when(F.col("rule") == "card", F.col("n").between(16, 19) & luhn(F.col("d")))
        .when(F.col("rule") == "phone", F.col("n").between(8, 15))
        .otherwise(F.lit(False))
    )
    loose = F.col("rule").startswith("loose")
    kind = F.when(F.col("rule") == "loose_email", "email").when(F.col("rule") == "loose_digits", F.when((F.col("n") <= 12) & F.col("m").rlike(r"^[0-9]+(?:\.[0-9]+){3}$"), "ip").when(F.col("n") >= 16, "card").otherwise("phone")).otherwise(F.col("rule"))
    rows = rows.withColumns({"base": valid, "kind": kind})
    return rows.where("base").unionByName(rows.where(loose & ((F.col("rule") == "loose_email") | F.col("n").between(7, 19)))).select("doc_id", "mark", "kind", "s", "e", "m", "before", "after", "base")


DATE = r"^(?:(?:19|20)[0-9]{2}[.-][01]?[0-9][.-][0-3]?[0-9]|[0-3]?[0-9][.-][01]?[0-9][.-](?:19|20)[0-9]{2})$"


def impossible() -> Column:
    """Whether a proposal can't be of its kind."""
    n, d = F.length(digits_of(F.col("m"))), digits_of(F.col("m"))
    touches = F.right("before", F.lit(1)).rlike("[A-Za-z0-9]") | F.left("after", F.lit(1)).rlike("[A-Za-z0-9]")
    phone = ~n.between(8, 15) | touches | F.col("m").rlike(DATE)
    return F.when(F.col("kind") == "card", ~(n.between(16, 19) & luhn(d)) | touches).when(F.col("kind") == "phone", phone).when(F.col("kind") == "ip", ~F.col("m").rlike(rf"^{SMALL_PART}(?:\.{SMALL_PART}){{3}}$")).otherwise(F.lit(False))


def rewritten(loose: DataFrame) -> DataFrame:
    """Confirmed proposals in forms that no base rule confirms; and, as wrong ones, cards with another last digit and addresses as the end of one sentence and the start of the next."""
    sure, m, digits = loose.where("confirmed = 1"), F.col("m"), digits_of(F.col("m"))
    forms = F.when(F.col("kind") == "phone", F.array(F.regexp_replace(m, r"^\+[0-9]{1,3}[\x20.-]*", ""), F.regexp_replace(m, r"^\+[0-9]{1,3}[\x20.()-]*", "0"), F.regexp_replace(m, r"^\+", "")))
    forms = forms.when(F.col("kind") == "card", F.array(F.regexp_replace(digits, "(.{4})(?!$)", "$1."), F.regexp_replace(digits, "(.{4})(?!$)", "$1  ")))
    forms = forms.when(F.col("kind") == "email", F.array(F.regexp_replace(F.regexp_replace(m, "@", " (at) "), "[.]", " (dot) "), F.regexp_replace(m, "@", "[at]"), F.regexp_replace(m, "[.]", " (dot) "))).otherwise(F.array(m))
    wrong = F.concat(F.left(m, F.length(m) - 1), F.pmod(F.right(m, F.lit(1)).cast("int") + 1, F.lit(10)).cast("string"))
    wrong = F.when(F.col("kind") == "card", wrong).when(F.col("kind") == "email", F.regexp_replace(F.regexp_replace(m, "@", " @ "), "[.]", ". "))
    return sure.withColumn("m", F.explode(forms)).unionByName(sure.where("kind in ('card', 'email')").withColumns({"m": wrong, "confirmed": F.lit(0.0)}))


def with_features(rows: DataFrame) -> DataFrame:
    """The numbers that the trees see."""
    m, edge = F.col("m"), lambda c: F.when(F.length(c) == 0, 0).when(c.rlike("[A-Za-z]"), 1).when(c.rlike("[0-9]"), 2).when(c == " ", 3).otherwise(4)
    groups = F.split(F.regexp_replace(m, "[^0-9A-Za-z]+", " "), " ")
    keyword = F.coalesce(*[F.when((F.col("kind") == k) & F.col("before").rlike(p), 1) for k, p in KEYWORDS.items()], F.lit(0))
    number = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])
    values = {
        "digits": F.regexp_count(m, F.lit("[0-9]")),
        "length": F.length(m),
        "groups": F.size(groups),
        "longest": F.array_max(F.transform(groups, F.length)),
        "dots": F.regexp_count(m, F.lit("[.]")),
        "dashes": F.regexp_count(m, F.lit("-")),
        "spaces": F.regexp_count(m, F.lit(" ")),
        "brackets": F.regexp_count(m, F.lit("[(]")),
        "plus": m.startswith("+").cast("int"),
        "at": m.contains("@").cast("int"),
        "before": edge(F.right("before", F.lit(1))),
        "after": edge(F.left("after", F.lit(1))),
        "keyword": keyword,
        "luhn": luhn(digits_of(m)).cast("int"),
        "kind": number[F.col("kind")],
    }
    return rows.select("doc_id", "mark", F.col("kind").alias("name"), "s", "e", "base", *[c for c in ("confirmed",) if c in rows.columns], *[v.cast("double").alias(k) for k, v in values.items()])


def fit_sample(loose: DataFrame, most: int) -> DataFrame:
    """At most so many rows, drawn by a hash: all of the rare kinds, and as many of each other kind."""
    counts = sorted((r["count"], r["kind"]) for r in loose.groupBy("kind").count().collect())
    parts, left = [], most
    for i, (n, kind) in enumerate(counts):
        take = min(n, left // (len(counts) - i))
        left -= take
        parts.append(loose.where(F.col("kind") == kind).orderBy(F.xxhash64("doc_id", "s", "e", *FEATURES), "doc_id", "s", "e", *FEATURES).limit(take))
    return reduce(DataFrame.unionByName, parts, loose.limit(0)).select(*FEATURES, "confirmed")


def thresholds(held: DataFrame, precision: float) -> dict[float, float]:
    """By kind, the lowest score above which at least that share of the rows (kind, score, confirmed) is confirmed."""
    # scores are rounded, so that the number of groups is bounded
    groups = held.groupBy("kind", "score").agg(F.sum("confirmed").alias("y"), F.count(F.lit(1)).alias("n")).collect()
    seen: dict[float, tuple[float, int]] = {}
    limits: dict[float, float] = {}
    for g in sorted(groups, key=lambda g: -g["score"]):
        y, n = seen.get(g["kind"], (0.0, 0))
        seen[g["kind"]] = y, n = y + g["y"], n + g["n"]
        if y >= precision * n:
            limits[g["kind"]] = g["score"]
    return limits


def detected(documents: DataFrame, fit_rows: int = FIT_ROWS, precision: float = PRECISION) -> DataFrame:
    """(doc_id, mark, spans): the selected spans of each text of (doc_id, text) that has any.

    spans is array<struct<k, s, e, base>> in the order of kind and start; k counts KINDS. A loose span that
    overlaps a base span gives way to it; loose spans of a kind come from one generator and don't overlap. Tables without proposals, or whose proposals are all alike, get the base spans only.
    """
    found = written(proposals(documents), "proposals")
    # a span meets a base one that starts no later and ends beyond its start, or one that starts no earlier and before its end
    of_text = Window.partitionBy("doc_id", "mark")
    ended = F.max(F.when(F.col("base"), F.col("e"))).over(of_text.orderBy("s").rangeBetween(Window.unboundedPreceding, 0))
    following = F.min(F.when(F.col("base"), F.col("s"))).over(of_text.orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, 0))
    meets = F.coalesce(F.col("ended") > F.col("s"), F.lit(False)) | F.coalesce(F.col("following") < F.col("e"), F.lit(False))
    loose = found.withColumns({"ended": ended, "following": following}).where("not base").withColumn("confirmed", F.when(meets, 1.0).when(impossible(), 0.0)).drop("ended", "following")
    raw = written(loose, "marked")
    folded = lambda df: df.withColumn("fold", F.pmod(F.xxhash64("doc_id"), F.lit(4)))
    shown = folded(written(with_features(rewritten(raw)), "rewritten"))
    loose = folded(written(with_features(raw), "loose"))
    dropped(raw)

    known = loose.where("confirmed is not null").unionByName(shown)
    sample = written(fit_sample(known.where("fold > 0"), fit_rows), "fit").coalesce(1)
    counts = sample.agg(F.sum("confirmed"), F.count(F.lit(1))).first()
    chosen = None
    if counts[0] and counts[0] < counts[1]:
        assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
        model = GBTClassifier(labelCol="confirmed", maxIter=12, maxDepth=4, seed=5, maxBins=64).fit(assembler.transform(sample))
        scored = lambda df: model.transform(assembler.transform(df)).withColumn("score", F.round(vector_to_array("probability")[1], 4)).drop("features", "probability", "rawPrediction", "prediction")
        limits = thresholds(scored(known.where("fold = 0").select(*FEATURES, "confirmed")), precision)
        if limits:
            limit = F.coalesce(*[F.when(F.col("kind") == k, F.lit(v)) for k, v in limits.items()], F.lit(2.0))
            chosen = scored(loose.where("confirmed is null")).where(F.col("score") >= limit).select("doc_id", "mark", "kind", "s", "e", "base")
    number = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])
    kept = found.where("base").select("doc_id", "mark", number[F.col("kind")].alias("kind"), "s", "e", "base")
    if chosen is not None:
        kept = kept.unionByName(chosen)
    span = F.struct(F.col("kind").cast("int").alias("k"), "s", "e", "base")
    spans = kept.groupBy("doc_id", "mark").agg(F.array_sort(F.collect_set(span)).alias("spans"))
    return spans


def span_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"], x["e"])), ",")


def report(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, the base counts n_email, n_ip, n_card, n_phone, base_sha256 and spans.

    Null texts are empty; rows with a null id are left out; rows that repeat an id get a row each. Texts without
    spans have zero counts, the digest of nothing and empty spans.
    """
    documents = texts_of(documents, id_col, text_col)
    keys = documents.select("doc_id", F.xxhash64("text").alias("mark"))
    out = keys.join(detected(documents), ["doc_id", "mark"], "left").withColumn("spans", F.coalesce("spans", F.array().cast("array<struct<k:int,s:int,e:int,base:boolean>>")))
    base = F.filter("spans", lambda x: x["base"])
    kinds = F.transform(base, lambda x: x["k"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, F.lit(i)))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return out.select("doc_id", *counts, F.sha2(span_text(base), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"))


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span's characters replaced by its kind in brackets; overlapping spans go by the earlier, longer one."""
    ordered = F.array_sort(spans, lambda a, b: F.when(a["s"] != b["s"], a["s"] - b["s"]).otherwise(b["e"] - a["e"]))
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        clear = x["s"] >= acc["at"]
        return F.struct(
            F.when(clear, x["e"]).otherwise(F.greatest(acc["at"], x["e"])).alias("at"),
            F.when(clear, F.concat(acc["out"], F.substring(text, acc["at"] + 1, x["s"] - acc["at"]), F.get(names, x["k"]))).otherwise(acc["out"]).alias("out"),
        )

    return F.aggregate(ordered, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text) - acc["at"])))


def redact(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """documents with the selected spans of the text replaced; all columns stay and null texts stay null.

    Rows with a null id pass unchanged, as report() has no row for them.
    """
    spans = detected(texts_of(documents, id_col, text_col)).select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"), F.col("spans").alias("_spans"))
    marked = documents.withColumn("_m", F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    out = marked.join(spans, (F.col(id_col).cast("long") == F.col("_id")) & (F.col("_m") == F.col("_mark")), "left")
    return out.withColumn(text_col, F.when(F.col("_spans").isNull(), F.col(text_col)).otherwise(redacted(F.col(text_col), F.col("_spans")))).select(*documents.columns)
