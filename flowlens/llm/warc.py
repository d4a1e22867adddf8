"""WARC archives as a Spark data source.

``spark.read.format("warc")`` plans one partition for each archive file, reads the headers of a record
first and skips what isn't wanted: records that the pushed predicates on record type or headers refuse,
and the payloads where the read schema has no payload column. Archives that this writer makes name each
member's compressed length in the gzip header (subfield "sl"), so that a skipped payload isn't even
inflated; members of other writers are inflated to find their ends.

Files are reached with pyarrow.fs, so a path may be any URI which that knows.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, WriterCommitMessage

from flowlens.llm.common import new_path

SCHEMA = "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_length bigint, payload binary"
#: column: WARC header
HEADERS = {
    "record_id": "WARC-Record-ID",
    "record_type": "WARC-Type",
    "target_uri": "WARC-Target-URI",
    "refers_to": "WARC-Refers-To",
    "payload_digest": "WARC-Payload-Digest",
    "payload_length": "WARC-X-Payload-Length",
}
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
ROLL_BYTES = 64 << 20
CHUNK = 1 << 20


def record_bytes(row: dict) -> bytes:
    """One record; a revisit carries no payload."""
    block = b"" if row["record_type"] == "revisit" else HTTP + (row["payload"] or b"")
    head = ["WARC/1.1", "WARC-Date: 2024-01-01T00:00:00Z"]
    head += [f"{h}: {row[c]}".replace("\r", " ").replace("\n", " ") for c, h in HEADERS.items() if row.get(c) is not None]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 1) -> bytes:
    """A gzip member that names its own length and the data's."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    size = 10 + 2 + 12 + len(body) + 8
    extra = b"sl" + struct.pack("<HII", 8, size & 0xFFFFFFFF, len(data) & 0xFFFFFFFF)
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class WarcWriter(DataSourceArrowWriter):
    """Writes each task's records to files of its own; a failed task's files are removed, a repeated task writes new names."""

    def __init__(self, path: str, roll: int) -> None:
        self.path, self.roll = path, roll

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = pafs.FileSystem.from_uri(self.path)
        fs.create_dir(root, recursive=True)
        files: list[str] = []
        out, size = None, 0
        try:
            for batch in iterator:
                names = batch.schema.names
                columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
                for values in zip(*columns, strict=True):
                    if out is None:
                        files.append(f"{root}/.{uuid.uuid4().hex}.warc.gz")
                        out, size = fs.open_output_stream(files[-1], compression=None), 0
                    size += out.write(member(record_bytes(dict(zip(names, values, strict=True)))))
                    if size >= self.roll:
                        out.close()
                        out = None
        finally:
            if out is not None:
                out.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        """The files get their visible names only when every task is done."""
        fs, root = pafs.FileSystem.from_uri(self.path)
        fs.create_dir(root, recursive=True)
        for i, message in enumerate(messages):
            for j, f in enumerate(message.files if message else []):
                fs.move(f, f"{root}/part-{i:05d}-{j:03d}-{uuid.uuid4().hex[:8]}.warc.gz")

    def abort(self, messages: list[Written | None]) -> None:
        fs, _ = pafs.FileSystem.from_uri(self.path)
        for message in messages:
            for f in message.files if message else []:
                fs.delete_file(f)


@dataclass
class ArchivePart(InputPartition):
    file: str


class Members:
    """The gzip members of a file, one after the other: (headers, a function that gives the block)."""

    def __init__(self, stream: pa.NativeFile) -> None:
        self.stream, self.buffer, self.at = stream, b"", 0

    def need(self, n: int) -> bool:
        """Whether n more bytes are there after the present place; reads them in."""
        while len(self.buffer) - self.at < n:
            more = self.stream.read(max(CHUNK, n - (len(self.buffer) - self.at)))
            if not more:
                return False
            self.buffer, self.at = self.buffer[self.at :] + more, 0
        return True

    def header(self) -> tuple[int, int | None]:
        """The length of the gzip header and, where it is named, of the whole member."""
        self.need(12)
        flags, size, total = self.buffer[self.at + 3], 10, None
        if flags & 4:
            n = struct.unpack_from("<H", self.buffer, self.at + 10)[0]
            self.need(12 + n)
            extra = self.buffer[self.at + 12 : self.at + 12 + n]
            size += 2 + n
            while len(extra) >= 4:
                width = struct.unpack_from("<H", extra, 2)[0]
                if extra[:2] == b"sl" and width >= 4:
                    total = struct.unpack_from("<I", extra, 4)[0]
                extra = extra[4 + width :]
        for flag in (8, 16):
            if flags & flag:
                while self.need(size + 1) and self.buffer[self.at + size]:
                    size += 1
                size += 1
        return size + 2 * bool(flags & 2), total

    def __iter__(self) -> Iterator[tuple[dict[str, str], callable]]:
        while self.need(1):
            size, total = self.header()
            inflate = zlib.decompressobj(-15)
            if total:
                if not self.need(total):
                    raise ValueError("an archive ends within a record")
                body = self.buffer[self.at + size : self.at + total - 8]
                head = inflate.decompress(body, 2048)
                while b"\r\n\r\n" not in head and inflate.unconsumed_tail:
                    head += inflate.decompress(inflate.unconsumed_tail, 4096)
                self.at += total
                yield self.parts(head, lambda head=head, i=inflate: head + i.decompress(i.unconsumed_tail) + i.flush())
                continue
            self.at += size
            data = b""
            while not inflate.eof:
                if not self.need(1):
                    raise ValueError("an archive ends within a record")
                data += inflate.decompress(self.buffer[self.at :])
                self.buffer, self.at = inflate.unused_data, 0
            self.need(8)
            self.at += 8
            yield self.parts(data, lambda data=data: data)

    @staticmethod
    def parts(head: bytes, whole: callable) -> tuple[dict[str, str], callable]:
        end = head.index(b"\r\n\r\n")
        lines = head[:end].decode().split("\r\n")[1:]
        fields = dict(line.split(": ", 1) for line in lines if ": " in line)
        return fields, lambda: whole()[end + 4 : end + 4 + int(fields["Content-Length"])]


class WarcReader(DataSourceReader):
    def __init__(self, path: str, columns: list[str], schema: pa.Schema) -> None:
        self.path, self.columns, self.schema = path, columns, schema
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters: list) -> Iterator:
        """Equality and membership on header columns are answered from the headers alone."""
        for f in filters:
            column = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if isinstance(f, (EqualTo, In)) and column in HEADERS and column != "payload_length":
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted[column] = self.wanted.get(column, values) & values
            elif isinstance(f, IsNotNull) and column in self.wanted:
                continue
            else:
                yield f

    def partitions(self) -> list[ArchivePart]:
        fs, root = pafs.FileSystem.from_uri(self.path)
        if fs.get_file_info(root).type == pafs.FileType.File:
            return [ArchivePart(root)]
        found = fs.get_file_info(pafs.FileSelector(root, allow_not_found=True))
        return [ArchivePart(f.path) for f in sorted(found, key=lambda f: f.path) if f.type == pafs.FileType.File and f.base_name.endswith(".warc.gz") and f.base_name[0] != "."] or [ArchivePart("")]

    def read(self, partition: ArchivePart) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        fs, _ = pafs.FileSystem.from_uri(self.path)
        rows: dict[str, list] = {c: [] for c in self.columns}
        size = 0
        with fs.open_input_stream(partition.file, compression=None) as stream:
            for fields, block in Members(stream):
                if any(fields.get(HEADERS[c]) not in v for c, v in self.wanted.items()):
                    continue
                for c in self.columns:
                    if c != "payload":
                        value = fields.get(HEADERS[c])
                        rows[c].append(int(value) if c == "payload_length" and value is not None else value)
                    elif fields.get("WARC-Type") == "revisit":
                        rows[c].append(None)
                    else:
                        data = block()
                        rows[c].append(data[data.index(b"\r\n\r\n") + 4 :] if data[:5] == b"HTTP/" else data)
                        size += len(rows[c][-1])
                size += 200
                if size > 8 << 20:
                    yield pa.RecordBatch.from_pydict(rows, schema=self.schema)
                    rows, size = {c: [] for c in self.columns}, 0
        if size:
            yield pa.RecordBatch.from_pydict(rows, schema=self.schema)


class WarcSource(DataSource):
    """Format "warc"; option path. A read schema with some of the columns reads only those."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        kinds = {"payload": pa.binary(), "payload_length": pa.int64()}
        names = [f.name for f in schema.fields]
        return WarcReader(self.options["path"], names, pa.schema([(n, kinds.get(n, pa.string())) for n in names]))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], int(self.options.get("rollBytes", ROLL_BYTES)))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def with_revisits(pages: DataFrame, id_col: str, url_col: str, html_col: str, least_bytes: int = 100) -> DataFrame:
    """The records of pages, in the columns of SCHEMA: of equal payloads of at least ``least_bytes`` the smallest id is the response.

    A null payload is empty. A null id is written as "none"; a row that repeats an id and its payload is a
    response as well. An empty table gives no record. Digests meet in a partially aggregated minimum; only
    those that occur twice are joined back, and adaptive execution may split a hot digest.
    """
    p = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("target_uri"), F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8").alias("payload"))
    p = p.withColumns({"digest": F.sha2("payload", 256), "payload_length": F.octet_length("payload").cast("long")})
    # this side reads only what a digest needs
    first = p.where(F.col("payload_length") >= least_bytes).groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first")
    p = p.join(first, "digest", "left")
    again = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("id"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    return p.select(
        urn(F.col("id")).alias("record_id"),
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        "target_uri",
        F.when(again, urn(F.col("first"))).alias("refers_to"),
        F.concat(F.lit("sha256:"), "digest").alias("payload_digest"),
        "payload_length",
        F.when(~again, F.col("payload")).alias("payload"),
    )


def write_archives(records: DataFrame, path: str, roll_bytes: int = ROLL_BYTES) -> str:
    """Writes records as archives under path, one or more files a task; returns path."""
    register(records.sparkSession)
    records.write.format("warc").option("rollBytes", roll_bytes).mode("append").save(path)
    return path


def read_archives(spark: SparkSession, path: str, columns: str = SCHEMA) -> DataFrame:
    register(spark)
    return spark.read.format("warc").schema(columns).load(path)


def archived_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes pages as WARC archives in the shared folder and reads them back: a row for each record.

    Columns: page_id, payload_bytes, payload_digest, record_type, refers_to. For responses, length and
    digest are those of the payload as read; a revisit has them in its headers and its payload isn't read.
    """
    spark = pages.sparkSession
    path = write_archives(with_revisits(pages, id_col, url_col, html_col), new_path(spark, "warc"))
    page = lambda c: F.expr(f"try_cast(regexp_extract({c}, 'urn:page:(-?[0-9]+)', 1) as bigint)")
    full = read_archives(spark, path).where("record_type = 'response'")
    full = full.select(page("record_id").alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"))
    again = read_archives(spark, path, SCHEMA.replace(", payload binary", "")).where("record_type = 'revisit'")
    again = again.select(page("record_id").alias("page_id"), F.col("payload_length").alias("payload_bytes"), F.substring_index("payload_digest", ":", -1).alias("payload_digest"), "record_type", page("refers_to").alias("refers_to"))
    return full.unionByName(again)
