"""What the operators share: the shared folder, written intermediate tables, Arrow batches by key."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); a temporary one where it is unset and all run on one machine."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base is None:
        base = spark.conf.get("flowlens.shared.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("flowlens.shared.dir", base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared folder; nothing is made there yet."""
    return f"{shared_dir(spark)}/flowlens-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, written to the shared folder and read from it: this cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes the folders of written tables that nothing reads any more, and frees the shuffle files of their plans."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
    if tables:
        freed(tables[0].sparkSession)


def freed(spark: SparkSession) -> None:
    """Has the driver collect its garbage, upon which Spark removes the shuffle files of plans that are no longer held."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def texts_of(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id long, text string) with null texts as empty ones; rows without an id can't be told apart and are left out."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).where("doc_id is not null")


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column without nulls, and the n + 1 offsets of its values."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else pa.binary()
    column = column.cast(kind)
    width = np.int64 if kind == pa.large_binary() else np.int32
    offsets = np.frombuffer(column.buffers()[1], width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def binary_column(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A binary column from bytes and offsets, without a copy for each value."""
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of arange(s, s + n) for each start and length."""
    ends = np.cumsum(lengths)
    if not len(ends) or not ends[-1]:
        return np.zeros(0, np.int64)
    return np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1])


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int) -> Iterator[pa.Table]:
    """Tables of about ``rows`` rows from batches sorted by keys; no group of equal keys is ever cut."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        count += batch.num_rows
        if count < rows:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        last = np.ones(table.num_rows, bool)
        for k in keys:
            v = table[k].to_numpy()
            last &= v == v[-1]
        cut = int(np.argmax(last))
        if cut:
            yield table.slice(0, cut)
        rest = table.slice(cut)
        held, count = rest.to_batches(), rest.num_rows
        # a group larger than the wanted size waits until twice as much has come, so that it isn't copied for each batch
        rows = max(rows, 2 * count)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def over_groups(df: DataFrame, keys: list[str], f: Callable[[pa.Table], pa.RecordBatch | None], schema: str, rows: int = 100_000) -> DataFrame:
    """f over tables of whole groups of df, dealt out and sorted by keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, keys, rows):
            out = f(table)
            if out is not None and out.num_rows:
                yield out

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def small_enough(df: DataFrame, rows: int) -> bool:
    """Whether df has at most so many rows; it stops counting there."""
    return df.limit(rows + 1).count() <= rows
