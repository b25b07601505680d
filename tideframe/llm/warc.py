"""WARC archives as a PySpark Python data source.

Reading plans one partition per archive of the folder's manifest. A record's headers are parsed first; predicates on the
record type and on headers (record_type, page_id, target_uri, payload_digest; =, in, null tests and, for page_id, comparisons) are
pushed down, and the payload of a record that they reject, or that nobody asks for, is passed over by seeking. Writing puts
each task's records in archives of about FILE_BYTES under names of its own and lists those of successful tasks in a
manifest, so archives of lost or repeated tasks are never read. Files are reached through pyarrow's file systems by URI.

Columns of pages beyond page_id, url and html are ignored, whatever their names; repeated rows are records each.

Options: path; payload ("false": the column payload is null); verify ("true": every payload that a response holds is held
against its digest, and a difference fails the read).
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, WriterCommitMessage

from .common import Bloom, build_bloom, plain, staged, work_path

FILE_BYTES = 64_000_000
#: Repeated payloads that are sent to all tasks, at most: 28 bytes of each.
SENT = 200_000
ROWS = 512
BATCH_BYTES = 8_000_000
MANIFEST = "manifest.json"
SCHEMA = "record_type string, record_id string, target_uri string, page_id bigint, payload_digest string, payload_bytes bigint, refers_to bigint, payload binary"


def digest_of(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _clean(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record: a response with its payload, or, with refers_to, a revisit that holds the HTTP headers only."""
    digest = digest_of(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>", "WARC-Date: 2024-01-01T00:00:00Z"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_clean(url)}")
    if page_id is not None:
        head.append(f"WARC-Page-ID: {page_id}")
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To-Page-ID: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(stream) -> dict[str, str] | None:
    """The header lines up to the empty one; None at the end of the file."""
    lines = []
    while True:
        line = stream.readline()
        if not line:
            if lines:
                raise ValueError("a record breaks off in its headers")
            return None
        line = line.rstrip(b"\r\n")
        if not line:
            if lines:
                break
            continue
        lines.append(line.decode("utf-8"))
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])} | {"": lines[0]}


class _Window:
    """readline, read and skip over a seekable file, with a buffer of its own."""

    def __init__(self, file, size: int = 1 << 20):
        self.file, self.size, self.buffer, self.at = file, size, b"", 0

    def _fill(self) -> bool:
        more = self.file.read(self.size)
        self.buffer, self.at = self.buffer[self.at :] + more, 0
        return bool(more)

    def readline(self) -> bytes:
        while (k := self.buffer.find(b"\n", self.at)) < 0:
            if not self._fill():
                k = len(self.buffer) - 1
                break
        out, self.at = self.buffer[self.at : k + 1], k + 1
        return out

    def read(self, n: int) -> bytes:
        while len(self.buffer) - self.at < n and self._fill():
            pass
        out, self.at = self.buffer[self.at : self.at + n], self.at + n
        if len(out) < n:
            raise ValueError("a record breaks off in its block")
        return out

    def skip(self, n: int) -> None:
        have = len(self.buffer) - self.at
        if n <= have:
            self.at += n
        else:
            self.file.seek(n - have, 1)
            self.buffer, self.at = b"", 0


@dataclass
class _File(InputPartition):
    uri: str


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"].rstrip("/")
        self.payload, self.verify = options.get("payload", "true") != "false", options.get("verify", "false") == "true"
        self.filters: list = []

    def pushFilters(self, filters: list) -> Iterator:
        kinds = (EqualTo, In, IsNull, IsNotNull, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)
        for f in filters:
            column = f.attribute[0] if isinstance(f, kinds) and len(f.attribute) == 1 else ""
            if column in ("record_type", "target_uri", "payload_digest") and isinstance(f, (EqualTo, In, IsNull, IsNotNull)) or column == "page_id":
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        fs, root = pafs.FileSystem.from_uri(self.path)
        with fs.open_input_stream(f"{root}/{MANIFEST}") as f:
            return [_File(f"{self.path}/{name}") for name in json.loads(f.read())]

    def _wanted(self, row: dict) -> bool:
        for f in self.filters:
            v = row[f.attribute[0]]
            if isinstance(f, IsNull):
                ok = v is None
            elif isinstance(f, IsNotNull):
                ok = v is not None
            elif v is None:
                ok = False
            elif isinstance(f, In):
                ok = v in f.value
            else:
                ok = {"EqualTo": v == f.value, "GreaterThan": v > f.value, "GreaterThanOrEqual": v >= f.value, "LessThan": v < f.value, "LessThanOrEqual": v <= f.value}[type(f).__name__]
            if not ok:
                return False
        return True

    def read(self, partition: _File | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # Spark asks for one partition where there is none
            return
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
        fs, path = pafs.FileSystem.from_uri(partition.uri)
        rows, held = [], 0

        def batch():
            return pa.record_batch([pa.array([r[n] for r in rows], t) for n, t in zip(names, types)], names=names)

        with fs.open_input_file(path) as file:
            stream = _Window(file)
            while (head := _headers(stream)) is not None:
                length = int(head["content-length"])
                number = lambda name: int(head[name]) if name in head else None
                row = {"record_type": head.get("warc-type"), "record_id": head.get("warc-record-id"), "target_uri": head.get("warc-target-uri"), "page_id": number("warc-page-id")}
                row |= {"payload_digest": head.get("warc-payload-digest", "").removeprefix("sha1:") or None, "refers_to": number("warc-refers-to-page-id"), "payload": None}
                if not self._wanted(row):
                    stream.skip(length + 4)
                    continue
                http, used = {}, 0
                while True:
                    line = stream.readline()
                    used += len(line)
                    if line in (b"\r\n", b"\n", b""):
                        break
                    k, _, v = line.decode("latin-1").partition(":")
                    http[k.strip().lower()] = v.strip()
                row["payload_bytes"] = int(http.get("content-length", length - used))
                if row["record_type"] == "response" and (self.payload or self.verify):
                    body = stream.read(length - used)
                    if self.verify and (digest_of(body) != row["payload_digest"] or len(body) != row["payload_bytes"]):
                        raise ValueError(f"the payload of {row['record_id']} isn't what its headers say")
                    row["payload"] = body if self.payload else None
                    held += len(body) if self.payload else 0
                    stream.skip(4)
                else:
                    stream.skip(length - used + 4)
                rows.append(row)
                if len(rows) >= ROWS or held > BATCH_BYTES:
                    yield batch()
                    rows, held = [], 0
        if rows:
            yield batch()


@dataclass
class _Written(WriterCommitMessage):
    names: list[str]


class WarcWriter(DataSourceArrowWriter):
    """Takes page_id, url, payload, refers_to."""

    def __init__(self, options: dict[str, str]):
        self.path = options["path"].rstrip("/")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, root = pafs.FileSystem.from_uri(self.path)
        fs.create_dir(root, recursive=True)
        names, out, size = [], None, 0
        try:
            for batch in iterator:
                for page, url, payload, refers in zip(*(batch[c].to_pylist() for c in ("page_id", "url", "payload", "refers_to"))):
                    if out is None or size > FILE_BYTES:
                        if out is not None:
                            out.close()
                        names.append(f"{uuid.uuid4().hex}.warc")
                        out, size = fs.open_output_stream(f"{root}/{names[-1]}"), 0
                    data = record(page, url, payload or b"", refers)
                    out.write(data)
                    size += len(data)
        finally:
            if out is not None:
                out.close()
        return _Written(names)

    def commit(self, messages: list) -> None:
        fs, root = pafs.FileSystem.from_uri(self.path)
        fs.create_dir(root, recursive=True)
        before = []
        if fs.get_file_info(f"{root}/{MANIFEST}").type != pafs.FileType.NotFound:
            with fs.open_input_stream(f"{root}/{MANIFEST}") as f:
                before = json.loads(f.read())
        with fs.open_output_stream(f"{root}/{MANIFEST}.new") as f:
            f.write(json.dumps(before + [n for m in messages if m for n in m.names]).encode())
        fs.move(f"{root}/{MANIFEST}.new", f"{root}/{MANIFEST}")

    def abort(self, messages: list) -> None:
        """Archives that no manifest lists are never read."""


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tideframe-warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def write_pages(pages: DataFrame, path: str, least_bytes: int = 0) -> None:
    """A record for each row of pages (page_id, url, html; null html is empty). Of records with equal payloads of at least
    least_bytes bytes the one with the largest page_id is a response and the others revisit it; rows that repeat that
    page_id are all responses, as are rows whose group has no page_id at all."""
    spark = pages.sparkSession
    register(spark)
    own = plain(pages, "page_id", "url", "html").withColumn("payload", F.coalesce("html", F.lit("")).cast("binary")).drop("html").withColumn("sha", F.unhex(F.sha1("payload")))
    large = F.octet_length("payload") >= least_bytes
    groups = own.where(large).groupBy("sha").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n")).where("n > 1 and last is not null")
    groups = staged(groups.select(F.col("sha").alias("of"), "last"), "repeated-payloads")
    refers = F.when(large & ~F.col("page_id").eqNullSafe(F.col("last")), F.col("last")).cast("bigint").alias("refers_to")
    shape = lambda df: df.join(groups if n > SENT else F.broadcast(groups), F.col("sha") == F.col("of"), "left").select("page_id", "url", "payload", refers)
    n = groups.count()
    if n <= SENT:
        out = shape(own)
    else:  # payloads move only where a filter holds their digest for repeated
        bloom = Bloom.sized(n, 24)
        sent = spark.sparkContext.broadcast(build_bloom(groups.select(F.xxhash64("of").alias("h")), bloom))
        keyed = own.withColumn("h", F.xxhash64("sha"))

        def split(wanted: bool):
            def run(batches):
                for batch in batches:
                    found = bloom.has(sent.value, batch["h"].to_numpy())
                    yield batch.filter(pa.array(found if wanted else ~found))

            return keyed.mapInArrow(run, keyed.schema)

        alone = split(False).select("page_id", "url", "payload", F.lit(None).cast("bigint").alias("refers_to"))
        out = alone.unionByName(shape(split(True)))
    out.write.format("tideframe-warc").mode("append").option("path", path).save()


def read_pages(spark: SparkSession, path: str, payload: bool = True, verify: bool = False) -> DataFrame:
    register(spark)
    return spark.read.format("tideframe-warc").option("payload", str(payload).lower()).option("verify", str(verify).lower()).load(path)


def archive(pages: DataFrame) -> DataFrame:
    """Writes and reads back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Responses are read with their payloads, each held against its digest; revisits by a pushed predicate on the record type, so that their
    reading passes over every payload. An empty table gives no rows.
    """
    path = work_path(pages.sparkSession, "warc")
    write_pages(pages, path)
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    responses = read_pages(pages.sparkSession, path, payload=False, verify=True).where("record_type = 'response'")
    revisits = read_pages(pages.sparkSession, path, payload=False).where("record_type = 'revisit'")
    return responses.select(*columns).unionByName(revisits.select(*columns))
