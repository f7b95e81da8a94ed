"""WARC archives as a Python data source: ``spark.read.format("warc")`` and ``df.write.format("warc")``.

Writing: every task writes archives of its own, one gzip member per record, under a name that the
driver makes visible when the job commits; a lost or repeated task leaves nothing that is read.
Reading: whole files are planned into partitions of about ``partition_bytes``; predicates on the
record type and on header columns are pushed down; a record's headers are parsed first, and the
payload of a record that a predicate or ``payload=false`` rules out is passed over undecoded.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, WriterCommitMessage

from vintara.llm.common import new_path

SCHEMA = ("record_id string, record_type string, target_uri string, refers_to string, date string, payload_digest string, "
          "payload_length bigint, content_type string, payload binary")
#: Column -> header. Any of these columns may be filtered by = or IN before the payload is touched.
HEADERS = {"record_id": "WARC-Record-ID", "record_type": "WARC-Type", "target_uri": "WARC-Target-URI", "refers_to": "WARC-Refers-To",
           "date": "WARC-Date", "payload_digest": "WARC-Payload-Digest", "payload_length": "X-Payload-Length", "content_type": "Content-Type"}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNK = 1 << 20
BATCH_BYTES = 8 << 20


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


class WarcDataSource(DataSource):
    """Options: ``path``; reading: ``payload`` (true), ``verify`` (false), ``partition_bytes`` (128 MiB); writing: ``file_bytes`` (1 GiB)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite:
            raise ValueError("archives are written once: use mode append and a new path")
        return WarcWriter(dict(self.options), [f.name for f in schema.fields])


# --- writing -----------------------------------------------------------------------------------


@dataclass
class Archives(WriterCommitMessage):
    files: list[str]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, columns: list[str]):
        self.path, self.limit = options["path"], int(options.get("file_bytes", 1 << 30))
        if missing := set(HEADERS) - set(columns) | {"payload"} - set(columns):
            raise ValueError(f"columns missing from the records: {sorted(missing)}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Archives:
        store, folder = fs.FileSystem.from_uri(self.path)
        store.create_dir(folder, recursive=True)
        files, out = [], None
        for batch in iterator:
            columns = {c: batch.column(batch.schema.get_field_index(c)).to_pylist() for c in [*HEADERS, "payload"]}
            for row in zip(*columns.values()):
                if out is None or out.tell() > self.limit:
                    if out is not None:
                        out.close()
                    files.append(f"{uuid.uuid4().hex}.warc.gz")
                    out = store.open_output_stream(f"{folder}/.{files[-1]}", compression=None)
                out.write(record(dict(zip(columns, row))))
        if out is not None:
            out.close()
        return Archives(files)

    def commit(self, messages: list[Archives | None]) -> None:
        store, folder = fs.FileSystem.from_uri(self.path)
        store.create_dir(folder, recursive=True)
        for message in messages:
            for file in message.files if message else []:
                store.move(f"{folder}/.{file}", f"{folder}/{file}")

    def abort(self, messages: list[Archives | None]) -> None:
        store, folder = fs.FileSystem.from_uri(self.path)
        for message in messages:
            for file in message.files if message else []:
                store.delete_file(f"{folder}/.{file}")


def record(row: dict) -> bytes:
    """One gzip member. A line break inside a header value would end the header: it becomes its percent code."""
    body = row["payload"] or b""
    lines = [f"{header}: {_line(row[column])}" for column, header in HEADERS.items() if row[column] is not None]
    if row["record_type"] == "revisit":
        lines.append(f"WARC-Profile: {PROFILE}")
    head = "\r\n".join(["WARC/1.1", *lines, f"Content-Length: {len(body)}", "", ""])
    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
    return packer.compress(head.encode()) + packer.compress(body) + packer.compress(b"\r\n\r\n") + packer.flush()


def _line(value) -> str:
    return str(value).replace("\r", "%0D").replace("\n", "%0A")


# --- reading -----------------------------------------------------------------------------------


@dataclass
class Files(InputPartition):
    paths: list[str]


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.payload = options.get("payload", "true") == "true"
        self.verify = options.get("verify", "false") == "true"
        self.partition_bytes = int(options.get("partition_bytes", 128 << 20))
        self.wanted: dict[str, set[str]] = {}

    def pushFilters(self, filters):
        for f in filters:
            column = getattr(f, "attribute", ("",))[0]
            if isinstance(f, (EqualTo, In)) and column in HEADERS and column != "payload_length":
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted[column] = self.wanted.get(column, values) & values
            else:
                yield f

    def partitions(self) -> list[Files]:
        store, folder = fs.FileSystem.from_uri(self.path)
        found = store.get_file_info(fs.FileSelector(folder, allow_not_found=True))
        plan, size = [Files([])], 0
        for info in sorted((i for i in found if i.is_file and not i.base_name.startswith(".")), key=lambda i: i.path):
            if size and size + info.size > self.partition_bytes:
                plan, size = [*plan, Files([])], 0
            plan[-1].paths.append(info.path)
            size += info.size
        return plan

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(self.path)
        rows, size = [], 0
        for path in partition.paths:
            with store.open_input_stream(path, compression=None, buffer_size=CHUNK) as file:
                for row in self._records(file):
                    rows.append(row)
                    size += len(row["payload"] or b"") + 500
                    if size > BATCH_BYTES:
                        yield _batch(rows)
                        rows, size = [], 0
        yield _batch(rows)

    def _records(self, file) -> Iterator[dict]:
        rest = b""
        while rest or (rest := file.read(CHUNK)):
            member, head = zlib.decompressobj(31), b""
            while (end := head.find(b"\r\n\r\n")) < 0:
                if not rest and not (rest := file.read(CHUNK)):
                    raise ValueError("an archive ends inside a record")
                head, rest = head + member.decompress(rest, 4096), member.unconsumed_tail
            row, length = _headers(head[:end])
            take = self.payload and all(row[c] in values for c, values in self.wanted.items())
            body = [head[end + 4 :]]
            rest = rest or member.unused_data
            while not member.eof:
                if not rest and not (rest := file.read(CHUNK)):
                    raise ValueError("an archive ends inside a record")
                piece, rest = member.decompress(rest, CHUNK), member.unconsumed_tail
                if take:
                    body.append(piece)
            rest = member.unused_data
            if not all(row[c] in values for c, values in self.wanted.items()):
                continue
            row["payload"] = b"".join(body)[:length] if take else None
            if self.verify and take and row["record_type"] == "response" and sha1_base32(row["payload"]) != row["payload_digest"]:
                raise ValueError(f"payload of {row['record_id']} does not have its digest")
            yield row


def _headers(head: bytes) -> tuple[dict, int]:
    named = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:] if ": " in line)
    row = {column: named.get(header) for column, header in HEADERS.items()}
    row["payload_length"] = int(row["payload_length"]) if row["payload_length"] is not None else None
    return row, int(named["Content-Length"])


ARROW = pa.schema([(c, pa.int64() if c == "payload_length" else pa.string()) for c in HEADERS] + [("payload", pa.binary())])


def _batch(rows: list[dict]) -> pa.RecordBatch:
    order = ["record_id", "record_type", "target_uri", "refers_to", "date", "payload_digest", "payload_length", "content_type", "payload"]
    return pa.RecordBatch.from_pylist(rows, pa.schema([ARROW.field(c) for c in order]))


# --- DataFrames to archives and back -------------------------------------------------------------


def write_pages(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                dedup_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write a record per page: response, or revisit of the smallest id among equal payloads of at least ``dedup_bytes``.

    A revisit carries the digest and length of the full payload and no payload. A null payload is
    empty. Rows that repeat the smallest id of their payload are responses like it; a null id
    counts as larger than any other (alone with its payload: a response with record id ``page:``). A null url
    leaves out the header. An empty table writes an empty folder. Other columns are not read.
    The first of equal payloads is found by grouping digests in the map stage, so a payload that a third of
    all pages share is one row per task; the join back may be split by Spark at a hot digest.
    """
    spark = pages.sparkSession
    spark.dataSource.register(WarcDataSource)
    kept = pages.select(pages[id_col].alias("id"), pages[url_col].cast("string").alias("url"), F.coalesce(pages[payload_col].cast("string"), F.lit("")).cast("binary").alias("payload"))
    kept = kept.withColumns({"sha": F.unhex(F.sha1("payload")), "size": F.octet_length("payload").cast("bigint")})
    first = kept.groupBy("sha", "size").agg(F.min("id").alias("first"))
    page = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    revisit = (F.col("size") >= dedup_bytes) & ~F.col("id").eqNullSafe(F.col("first"))
    joined = kept.join(first, ["sha", "size"])
    records = joined.select(
        page(F.col("id")).alias("record_id"), F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.col("url").alias("target_uri"),
        F.when(revisit, page(F.col("first"))).alias("refers_to"), F.lit(date).alias("date"), base32(F.col("sha")).alias("payload_digest"),
        F.col("size").alias("payload_length"), F.lit("text/html; charset=utf-8").alias("content_type"), F.when(~revisit, F.col("payload")).alias("payload"))
    records.write.format("warc").mode("append").save(path)


def base32(binary):
    """Base32 of 20 bytes, in built-in functions: five bits a letter from the number's binary digits."""
    bits = F.concat(*[F.lpad(F.conv(F.hex(F.substring(binary, 5 * k + 1, 5)), 16, 2), 40, "0") for k in range(4)])
    letter = lambda k: F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), (F.conv(F.substring(bits, 5 * k + 1, 5), 2, 10).cast("int") + 1), F.lit(1))
    return F.concat(*[letter(k) for k in range(32)])


def read_warc(spark: SparkSession, path: str, **options) -> DataFrame:
    """The records of all archives in a folder; filters on header columns reach the reader."""
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("warc").options(**options).load(path)


def archived_pages(pages: DataFrame, dedup_bytes: int = 0) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read the records back, ids as numbers again."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    path = path if "://" in path or path.startswith("file:") else f"file://{path}"
    path = path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file:///") else path
    write_pages(pages, path, dedup_bytes=dedup_bytes)
    number = lambda c: F.nullif(F.regexp_extract(c, r"page:(-?\d*)>", 1), F.lit("")).cast("bigint")
    records = read_warc(spark, path, verify="true")
    return records.withColumns({"page_id": number(F.col("record_id")), "refers_to": number(F.col("refers_to"))})
