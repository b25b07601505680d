"""Delimited text files as a PySpark data source: texts as they stand, each with its row's number in its file.

A file without a header, with a column twice, or with a row of another width fails; names are literal, and a byte order mark isn't
stripped. Spark's own reader would rename columns, fill short rows with nulls, and has no row numbers. A file is one partition, as
quoted fields may hold line breaks.
"""

from __future__ import annotations

import csv
import fnmatch
import io
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import exprs as E
from ..functions import files

#: Rows of a batch.
ROWS = 4096


class ProviderError(ValueError):
    """Something wrong with a source."""


class NotConfigured(ProviderError):
    """A source without something that it needs to be told."""


class Capability(ProviderError):
    """A request that a source can't serve."""


class Decode(ProviderError):
    """A file that can't be read as what it should be."""


@dataclass(frozen=True)
class Request:
    """A record type and a symbol, with a half-open window in microseconds."""

    record_type: str
    symbol: str
    start: int | None = None
    end: int | None = None

    def __post_init__(self) -> None:
        if not self.symbol or self.symbol != self.symbol.strip():
            raise ValueError(f"a symbol is neither blank nor padded: {self.symbol!r}")
        if self.start is not None and self.end is not None and self.end <= self.start:
            raise ValueError("a window ends after it starts")

    def contains(self, at: int) -> bool:
        return (self.start is None or at >= self.start) and (self.end is None or at < self.end)


def _text(path: str, encoding: str):
    """A file's text as it stands, by path or URI."""
    fs, own = files.at(path)
    return io.TextIOWrapper(fs.open_input_file(own), encoding=encoding, newline="")


def header_of(path: str, encoding: str = "utf-8") -> list[str]:
    with _text(path, encoding) as f:
        names = next(csv.reader(f), None)
    if not names:
        raise Decode(f"{path} has no header")
    twice = sorted({n for n in names if names.count(n) > 1})
    if twice:
        raise Decode(f"{path} has columns twice: {', '.join(twice)}")
    return names


@dataclass
class _File(InputPartition):
    path: str


class DelimitedReader(DataSourceReader):
    """A file is a partition, read as a stream and given out in Arrow batches; it is closed when it ends, fails, or isn't read on."""

    def __init__(self, options: dict[str, str], names: list[str]):
        self.paths, self.encoding, self.names = _paths(options), options.get("encoding", "utf-8"), names

    def partitions(self) -> list[InputPartition]:
        return [_File(p) for p in self.paths]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        names = ["__file", "source_index", *self.names]

        def batch(begin: int, rows: list[list[str]]) -> pa.RecordBatch:
            fixed = [pa.array([partition.path] * len(rows), pa.string()), pa.array(range(begin, begin + len(rows)), pa.int64())]
            return pa.RecordBatch.from_arrays([*fixed, *[pa.array(c, pa.string()) for c in zip(*rows)]], names=names)

        with _text(partition.path, self.encoding) as f:
            found = csv.reader(f, strict=True)
            if next(found, None) != self.names:
                raise Decode(f"{partition.path} has another header than the first file")
            held: list[list[str]] = []
            begin = 0
            for row in found:
                if len(row) != len(self.names):
                    raise Decode(f"row {begin + len(held)} of {partition.path} has {len(row)} fields, the header {len(self.names)}")
                held.append(row)
                if len(held) == ROWS:
                    yield batch(begin, held)
                    begin, held = begin + len(held), []
            if held:
                yield batch(begin, held)


def _paths(options: dict[str, str]) -> list[str]:
    """The files that a path, a folder's path, or a pattern in its last part names, sorted."""
    if "path" not in options:
        raise NotConfigured("a path is needed")
    folder, _, last = options["path"].rstrip("/").rpartition("/")
    if any(c in last for c in "*?["):
        found = [files.join(folder, n) for n in files.names(folder) if fnmatch.fnmatch(n, last)]
    else:
        found = [options["path"]] if files.exists(options["path"]) else []
    if not found:
        raise NotConfigured(f"no file at {options['path']}")
    return found


class DelimitedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tideframe-delimited"

    def _names(self) -> list[str]:
        return header_of(_paths(dict(self.options))[0], self.options.get("encoding", "utf-8"))

    def schema(self) -> str:
        return "`__file` string, source_index bigint, " + ", ".join(f"`{n.replace('`', '``')}` string" for n in self._names())

    def reader(self, schema) -> DelimitedReader:
        return DelimitedReader(dict(self.options), self._names())


def read_delimited(spark: SparkSession, path: str, encoding: str = "utf-8") -> DataFrame:
    spark.dataSource.register(DelimitedSource)
    return spark.read.format("tideframe-delimited").option("encoding", encoding).load(path)


def excluded(request: Request, symbol, at_us):
    """Whether a request leaves a record out: another symbol, or a valid instant outside the window; invalid ones stay, to be reported."""
    other = F.coalesce(symbol != request.symbol, F.lit(False))
    outside = F.coalesce(~E.in_range(at_us, request.start, request.end), F.lit(False))
    return other | outside


def reconciled(embedded, configured: str | None):
    """The symbol of a record: the file's own, which must agree with a configured one, or that; neither is an error."""
    if configured is not None and not configured.strip():
        raise NotConfigured("a configured symbol isn't blank")
    own = F.when(E.stripped(embedded) != "", embedded)
    if configured is None:
        return F.coalesce(own, F.raise_error(F.lit("a record without a symbol")).cast("string"))
    return F.when(own.isNull() | (own == configured), F.lit(configured)).otherwise(F.raise_error(F.concat(F.lit(f"configured for {configured}, but the file says "), own)).cast("string"))


def fetch_csv(spark: SparkSession, path: str, request: Request, record_type: str, configured_symbol: str | None = None, encoding: str = "utf-8") -> DataFrame:
    """Raw records (texts) of a provider-neutral file that a request asks for; what can't be read stays as it is, for validation."""
    from ..schemas import FIELDS

    if request.record_type != record_type:
        raise Capability(f"the file holds {record_type}s")
    raw = read_delimited(spark, path, encoding)
    names = [c for c in raw.columns if not c.startswith("__")]
    symbol = reconciled(F.col("instrument_symbol") if "instrument_symbol" in names else F.lit(None).cast("string"), configured_symbol)
    cols = [F.col("source_index")] + [symbol.alias(f) if f == "instrument_symbol" else (F.col(f) if f in names else F.lit(None).cast("string")).alias(f) for f in FIELDS[record_type]]
    extra = [n for n in names if n not in FIELDS[record_type] and n != "source_index"]
    out = raw.select(*cols, F.array(*[F.lit(n) for n in extra]).cast("array<string>").alias("extra"))
    return out.where(~excluded(request, F.col("instrument_symbol"), E.utc_micros(F.col("timestamp"))))
