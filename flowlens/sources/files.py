"""Readers and writers of flow files, JSON events and dataset rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.functions.scalars import json_depth
from flowlens.operators.dataset import map_labels
from flowlens.operators.flows import FEATURES

#: the columns of a flow file, and the two that may be left out
FLOW_FILE = "first_seen timestamp, last_seen timestamp, duration double, source_ip string, destination_ip string, source_port int, destination_port int, protocol string, forward_packet_count long, backward_packet_count long, forward_bytes long, backward_bytes long"
OPTIONAL = "ground_truth_label string, attack_family string"


def read_flow_csv(spark: SparkSession, path: str) -> DataFrame:
    """Flows of CSV files with a header; malformed rows keep their text in _corrupt.

    The header must hold every required column, none twice, and none beyond the optional two.
    """
    header = spark.read.text(path).limit(1).first()
    names = header[0].split(",") if header else []
    required = [f.name for f in T.StructType.fromDDL(FLOW_FILE).fields]
    optional = [f.name for f in T.StructType.fromDDL(OPTIONAL).fields]
    if len(set(names)) != len(names) or set(required) - set(names) or set(names) - {*required, *optional}:
        raise ValueError(f"unexpected header: {names}")
    kinds = {f.name: f for f in T.StructType.fromDDL(f"{FLOW_FILE}, {OPTIONAL}").fields}
    schema = T.StructType([*(kinds[n] for n in names), T.StructField("_corrupt", T.StringType())])
    return spark.read.csv(path, header=True, schema=schema, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt")


def read_json_events(spark: SparkSession, path: str, depth: int = 64, size: int = 1 << 20) -> DataFrame:
    """(value, error) of JSON-lines files: error names why a line isn't a valid object, or is null."""
    lines = spark.read.text(path)
    v = F.col("value")
    kind = F.schema_of_variant(F.try_parse_json(v))
    error = F.when(F.length(F.trim(v)) == 0, "blank").when(F.octet_length(v) > size, "too_large").when(json_depth(v) > depth, "too_deep").when(F.try_parse_json(v).isNull(), "malformed").when(~kind.startswith("OBJECT"), "not_an_object")
    return lines.select("value", error.alias("error"))


def write_splits(assignments: DataFrame, path: str) -> None:
    """One folder for each split; an existing path is an error."""
    assignments.write.mode("errorifexists").partitionBy("split").parquet(path)


def write_dataset_rows(rows: DataFrame, path: str) -> None:
    """JSON lines; an existing path is an error."""
    rows.write.mode("errorifexists").json(path)


def read_dataset_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path, mode="FAILFAST")


#: what a file of features has before them (fixed values of the format)
FEATURE_METADATA = ("record_id", "capture_session_id", "scenario_id", "group_id", "original_row_id", "observed_at", "original_label")


def convert_feature_csv(spark: SparkSession, path: str, rules: DataFrame, dataset_id: str, dataset_version: str) -> DataFrame:
    """Dataset rows of files of features: metadata, provenance, the features in their order, labels by an alias table, and ``error``.

    The header must be FEATURE_METADATA and FEATURES exactly. error names the first thing that is wrong with a row: malformed, a missing id, a time
    without its zone, a feature that is missing or not finite, an unmapped label; null where nothing is. A file's SHA-256 is of its bytes.
    """
    names = [*FEATURE_METADATA, *FEATURES]
    for row in spark.read.text(path).where(F.col("value").startswith("record_id") | F.col("value").startswith("\ufeff")).distinct().limit(2).collect():
        if [n.strip() for n in row[0].lstrip("\ufeff").split(",")] != names:
            raise ValueError(f"unexpected header: {row[0][:200]}")
    schema = T.StructType([*[T.StructField(n, T.StringType()) for n in names], T.StructField("_corrupt", T.StringType())])
    rows = spark.read.csv(path, header=True, schema=schema, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt", enforceSchema=False).withColumn("_file", F.input_file_name())
    sums = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256).alias("source_file_checksum"), F.element_at(F.split("path", "/"), -1).alias("source_file"))
    rows = rows.withColumn("source_file", F.element_at(F.split(F.url_decode("_file"), "/"), -1)).join(sums, "source_file", "left")
    rows = map_labels(rows, rules, "original_label")
    seen = F.when(F.col("observed_at").rlike(r"(?:[zZ]|[+-]\d{2}:?\d{2})$"), F.try_to_timestamp(F.col("observed_at")))
    number = {f: F.col(f).try_cast("double") for f in FEATURES}
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    bad = F.coalesce(*[F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), F.lit(f)) for f, v in number.items()])
    error = F.when(F.col("_corrupt").isNotNull(), "malformed").when(F.coalesce(*[F.when(blank(c), F.lit(c)) for c in FEATURE_METADATA[:5]]).isNotNull(), F.concat(F.lit("missing:"), F.coalesce(*[F.when(blank(c), F.lit(c)) for c in FEATURE_METADATA[:5]])))
    error = error.when(seen.isNull(), "observed_at").when(bad.isNotNull(), F.concat(F.lit("feature:"), bad)).when(F.col("unmapped"), "unmapped_label")
    about = {"dataset_id": F.lit(dataset_id), "dataset_version": F.lit(dataset_version)}
    return rows.select(
        *[v.alias(k) for k, v in about.items()], *FEATURE_METADATA[:5], seen.alias("observed_at"), "source_file", "source_file_checksum", *[v.alias(f) for f, v in number.items()], "original_label", "binary_label", "family", error.alias("error")
    )


def write_export(rows: DataFrame, root: str, version: str, counted: tuple[str, ...], id_col: str, order: tuple[str, ...]) -> DataFrame:
    """Writes rows as JSON lines below root/version and, beside them, a manifest (what, value, n) of counts by each counted column; returns it.

    A version that is there is an error, so that none is ever overwritten; rows are in order, and the ids have a digest that their order doesn't change.
    """
    spark = rows.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{version}")
    if path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(path):
        raise FileExistsError(f"version {version} is there")
    rows.orderBy(*order).write.mode("errorifexists").json(f"{root}/{version}/rows")
    counts = [rows.groupBy(F.col(c).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(c).alias("what"), "value", "n") for c in counted]
    bits = F.conv(F.substring(F.sha2(F.col(id_col).cast("string"), 256), 1, 13), 16, 10).cast("decimal(38,0)")
    manifest = rows.agg(F.coalesce(F.sum(bits), F.lit(0)).cast("string").alias("value"), F.count(F.lit(1)).alias("n")).select(F.lit("ids").alias("what"), "value", "n")
    for c in counts:
        manifest = manifest.unionByName(c)
    manifest.coalesce(1).write.mode("errorifexists").json(f"{root}/{version}/manifest")
    return spark.read.schema("what string, value string, n long").json(f"{root}/{version}/manifest")


#: tables of comparisons and what each of their rows has to have (fixed values of the format)
METRIC_FILES = {
    "known": "mode string, recall double, f1 double, macro_f1 double, pr_auc double, false_positive_rate double, tn long, fp long, fn long, tp long",
    "leave_one_family_out": "held_out_family string, mode string, recall double, f1 double, macro_f1 double, false_positive_rate double",
    "intervals": "mode string, metric string, lower double, upper double, draws long",
}


def read_metric_csv(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """The rows of a saved comparison table with error: null, or the first required column that is missing, malformed or not finite."""
    if kind not in METRIC_FILES:
        raise ValueError(f"no table of metrics: {kind}")
    wanted = T.StructType.fromDDL(METRIC_FILES[kind]).fields
    raw = spark.read.csv(path, header=True)
    lacking = [f.name for f in wanted if f.name not in raw.columns]
    if lacking:
        raise ValueError(f"{kind} lacks {lacking}")
    value = {f.name: F.trim(f.name) if isinstance(f.dataType, T.StringType) else F.col(f.name).try_cast(f.dataType) for f in wanted}
    bad = lambda f: (value[f.name] == "") | value[f.name].isNull() if isinstance(f.dataType, T.StringType) else value[f.name].isNull() | (F.isnan(value[f.name].cast("double")) | (F.abs(value[f.name].cast("double")) == float("inf")))
    error = F.coalesce(*[F.when(F.coalesce(bad(f), F.lit(True)), F.lit(f.name)) for f in wanted])
    return raw.select(*[v.alias(n) for n, v in value.items()], error.alias("error"))
