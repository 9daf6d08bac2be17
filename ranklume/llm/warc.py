"""WARC archives as a PySpark data source, and de-duplicating archiving of pages.

``spark.read.format("warc")`` plans partitions of whole files (small files are
packed together), pushes predicates on the record type and on the headers that
are columns down to the parser, reads a record's headers first, and skips the
block of a record that the predicates reject without decoding it.  With the
option ``payload`` set to ``false`` blocks are never decoded.  The digest of
every payload that is decoded is checked against the record's header.

``df.write.format("warc")`` writes one archive a task, each record a gzip
member.  Files are made under a staging folder and moved into place on commit,
so that lost and repeated tasks leave nothing behind.

Paths can be in any store that pyarrow can open.

Nulls: a null payload is empty; a null URI or id leaves its header out.  Empty
input: no files; reading a folder without archives gives no rows.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage

from ..shipping import ship
from .common import new_shared_path, settled

SCHEMA = "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary"
# The header of each column, as named by WARC 1.1.
HEADERS = {
    "record_id": "warc-record-id",
    "record_type": "warc-type",
    "target_uri": "warc-target-uri",
    "refers_to": "warc-refers-to",
    "payload_digest": "warc-payload-digest",
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ARCHIVES = (".warc", ".warc.gz")
BATCH_BYTES = 8 << 20


def digest_of(payload: bytes) -> str:
    """Bare upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def store(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path and the path in it."""
    return pafs.FileSystem.from_uri(path if "://" in path else "file://" + path[5:] if path.startswith("file:") else path)


def _line(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def encode_record(record_id: str | None, record_type: str, target_uri: str | None, refers_to: str | None, payload: bytes | None, digest: str | None, length: int | None, date: str) -> bytes:
    """One record, uncompressed.  A revisit has the HTTP header of its payload and no payload."""
    payload = payload or b""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload) if length is None else length}\r\n\r\n".encode()
    block = http if record_type == "revisit" else http + payload
    head = ["WARC/1.1", f"WARC-Type: {record_type}", f"WARC-Date: {date}"]
    if record_id is not None:
        head.append(f"WARC-Record-ID: <{_line(record_id)}>")
    if target_uri is not None:
        head.append(f"WARC-Target-URI: {_line(target_uri)}")
    if record_type == "revisit":
        head.append(f"WARC-Profile: {PROFILE}")
    if refers_to is not None:
        head.append(f"WARC-Refers-To: <{_line(refers_to)}>")
    head += [f"WARC-Payload-Digest: sha1:{digest or digest_of(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return ("\r\n".join(head) + "\r\n\r\n").encode("utf-8") + block + b"\r\n\r\n"


def records(stream: io.BufferedIOBase, wanted, with_payload: bool) -> Iterator[tuple]:
    """Rows of ``SCHEMA`` of the records whose headers ``wanted`` accepts."""
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        head: dict[str, str] = {}
        while (line := stream.readline().rstrip(b"\r\n")) != b"":
            key, _, value = line.decode("utf-8").partition(":")
            head[key.strip().lower()] = value.strip()
        length = int(head.get("content-length", 0))
        strip = lambda v: v[1:-1] if v and v.startswith("<") and v.endswith(">") else v
        row = {c: strip(head.get(h)) for c, h in HEADERS.items()}
        if row["payload_digest"]:
            row["payload_digest"] = row["payload_digest"].rpartition(":")[2]
        if not wanted(row):
            _skip(stream, length)
            continue
        if not with_payload:
            _skip(stream, length)
            yield (*row.values(), None, None)
            continue
        block = stream.read(length)
        if len(block) < length:
            raise EOFError(f"record {row['record_id']} is cut off")
        payload, size = block, len(block)
        if head.get("content-type", "").startswith("application/http"):
            http, _, payload = block.partition(b"\r\n\r\n")
            size = next((int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), len(payload))
        if row["record_type"] == "revisit":
            payload = None
        elif row["payload_digest"] and digest_of(payload) != row["payload_digest"]:
            raise ValueError(f"record {row['record_id']}: its payload doesn't have its digest")
        yield (*row.values(), size, payload)


def _skip(stream, n: int) -> None:
    while n > 0 and (got := stream.read(min(n, 1 << 20))):
        n -= len(got)


@dataclass
class Files(InputPartition):
    paths: list[str]


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.with_payload = options["path"], str(options.get("payload", "true")).lower() != "false"
        self.partition_bytes = int(options.get("partitionBytes", 32 << 20))
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters):
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            kind = {EqualTo: "eq", In: "in", IsNotNull: "set", StringStartsWith: "starts", StringEndsWith: "ends", StringContains: "has"}.get(type(f))
            if column in HEADERS and kind:
                self.tests.append((column, kind, getattr(f, "value", None)))
            else:
                yield f

    def partitions(self):
        fs, root = store(self.path)
        info = fs.get_file_info(root)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [info] if info.type == pafs.FileType.File else [x for x in fs.get_file_info(pafs.FileSelector(root, recursive=True)) if x.type == pafs.FileType.File and x.path.endswith(ARCHIVES) and "/_" not in x.path[len(root) :]]
        parts, held = [], 0
        for x in sorted(found, key=lambda x: x.path):
            if not parts or held + x.size > self.partition_bytes:
                parts.append(Files([]))
                held = 0
            parts[-1].paths.append(x.path)
            held += x.size
        return parts or [Files([])]

    def read(self, partition):
        fs, _ = store(self.path)
        tests = {
            "eq": lambda v, x: v == x,
            "in": lambda v, x: v in x,
            "set": lambda v, x: v is not None,
            "starts": lambda v, x: v is not None and v.startswith(x),
            "ends": lambda v, x: v is not None and v.endswith(x),
            "has": lambda v, x: v is not None and x in v,
        }
        wanted = lambda row: all(tests[kind](row[column], value) for column, kind, value in self.tests)
        names = [*HEADERS, "payload_bytes", "payload"]
        types = [pa.string()] * len(HEADERS) + [pa.int64(), pa.binary()]
        for path in partition.paths:
            with fs.open_input_stream(path, compression=None) as raw:
                stream = io.BufferedReader(gzip.GzipFile(fileobj=io.BufferedReader(raw, 1 << 18)), 1 << 18) if path.endswith(".gz") else io.BufferedReader(raw, 1 << 18)
                rows, held = [], 0
                for row in records(stream, wanted, self.with_payload):
                    rows.append(row)
                    held += 200 + len(row[-1] or b"")
                    if held > BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


@dataclass
class Written(WriterCommitMessage):
    name: str | None


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite, self.date = options["path"], overwrite, options.get("date", "1970-01-01T00:00:00Z")
        self.level, self.job = int(options.get("level", 4)), uuid.uuid4().hex

    def _staging(self, root: str) -> str:
        return f"{root}/_staging-{self.job}"

    def write(self, iterator):
        fs, root = store(self.path)
        fs.create_dir(self._staging(root), recursive=True)
        name, out = None, None
        try:
            for batch in iterator:
                cols = {c: batch.column(i) for i, c in enumerate(batch.schema.names)}
                value = lambda c, i: cols[c][i].as_py() if c in cols else None
                for i in range(batch.num_rows):
                    if out is None:
                        name = f"part-{uuid.uuid4().hex}.warc.gz"
                        out = fs.open_output_stream(f"{self._staging(root)}/{name}", compression=None)
                    data = encode_record(value("record_id", i), value("record_type", i) or "response", value("target_uri", i), value("refers_to", i), value("payload", i), value("payload_digest", i), value("payload_bytes", i), self.date)
                    member = zlib.compressobj(self.level, zlib.DEFLATED, 31)
                    out.write(member.compress(data) + member.flush())
        finally:
            if out is not None:
                out.close()
        return Written(name)

    def commit(self, messages):
        fs, root = store(self.path)
        fs.create_dir(root, recursive=True)
        if self.overwrite:
            for x in fs.get_file_info(pafs.FileSelector(root)):
                if x.type == pafs.FileType.File and x.path.endswith(ARCHIVES):
                    fs.delete_file(x.path)
        for m in messages:
            if m is not None and m.name:
                fs.move(f"{self._staging(root)}/{m.name}", f"{root}/{m.name}")
        self._drop(fs, root)

    def abort(self, messages):
        self._drop(*store(self.path))

    def _drop(self, fs, root):
        if fs.get_file_info(self._staging(root)).type == pafs.FileType.Directory:
            fs.delete_dir(self._staging(root))


class WarcDataSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def base32_sha1(payload: F.Column) -> F.Column:
    """:func:`digest_of` as a JVM expression: 40 bits are 10 hex and 8 base32 digits."""
    hexed = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(hexed, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def plan_records(pages: DataFrame, min_bytes: int = 0, id_col: str = "page_id", uri_col: str = "url", body_col: str = "html") -> DataFrame:
    """Records of pages: of equal payloads of ``min_bytes`` or more, the smallest id is the response, others revisit it.

    Rows with the smallest id itself, and rows of payloads that only null ids
    have, are responses.
    """
    body = F.coalesce(F.col(body_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("id"), F.col(uri_col).alias("target_uri"), body.alias("payload")).withColumn("payload_digest", base32_sha1(F.col("payload"))).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    # as files, so that the join exchanges both sides and a very frequent payload is split
    first = settled(rows.select("id", "payload_digest").groupBy("payload_digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"))
    again = F.col("first").isNotNull() & ~F.coalesce(F.col("id") == F.col("first"), F.lit(False)) & (F.col("payload_bytes") >= min_bytes)
    name = lambda c: F.concat(F.lit("urn:page:"), F.col(c).cast("string"))
    return rows.join(first, "payload_digest", "left").select(
        name("id").alias("record_id"), F.when(again, "revisit").otherwise("response").alias("record_type"), "target_uri", F.when(again, name("first")).alias("refers_to"), "payload_digest", "payload_bytes", F.when(~again, F.col("payload")).alias("payload")
    )


def archive(pages: DataFrame, path: str | None = None, min_bytes: int = 0, **columns) -> str:
    """Writes the pages as WARC files and returns their folder."""
    spark = pages.sparkSession
    register(spark)
    path = path or new_shared_path(spark, "warc")
    plan_records(pages, min_bytes, **columns).write.format("warc").mode("append").save(path)
    return path


def read(spark: SparkSession, path: str, **options) -> DataFrame:
    register(spark)
    return spark.read.format("warc").options(**options).load(path)
