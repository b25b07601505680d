"""Shared plumbing of the training-data operators: the shared work folder, staged tables and Bloom filters."""

from __future__ import annotations

import ctypes
import gc
import math
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space that separates words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the context's own checkpoint folder. A session of one
    process, as in tests, may do without and gets one of its own; others can't."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        context = spark.sparkContext._jsc.sc()
        if context.getCheckpointDir().isEmpty():
            if not context.isLocal():
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='tideframe-')}")
        base = context.getCheckpointDir().get()
    return base.rstrip("/")


def work_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: cuts lineage, survives lost executors, is computed once."""
    spark, path = df.sparkSession, work_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def unstage(*tables: DataFrame | None) -> None:
    """Deletes staged tables that nothing will read again; what was made of them has been written."""
    for df in tables:
        if (path := getattr(df, "staged_at", None)) is not None:
            spark = df.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def numbered(df: DataFrame) -> DataFrame:
    """df with its columns named c0, c1 and so on, so that no name clashes, not even by case."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def place(df: DataFrame, column: str) -> str:
    """What numbered() calls a column: the one of exactly this name, else the first that differs by case only."""
    names = df.columns
    at = names.index(column) if column in names else [c.lower() for c in names].index(column.lower())
    return f"c{at}"


def plain(df: DataFrame, *columns: str) -> DataFrame:
    """Only these columns, whatever else the table holds and however it is named."""
    return numbered(df).select(*[F.col(place(df, c)).alias(c) for c in columns])


def trimmed() -> None:
    """Gives memory that this worker no longer uses back to the system: workers live on after their stage."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def relieved(spark: SparkSession) -> None:
    """Has executors collect their garbage, so that what a stage left of their heaps, and of buffers beside these, goes back to the
    system before the next stage's workers ask for it. One short task for each core; nothing depends on where they run."""
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.expr("java_method('java.lang.System', 'gc')")).collect()


def hot(groups: DataFrame, size: str, share: int = 1024) -> DataFrame:
    """The groups that hold more than a 1/share of all rows; there are fewer than `share`, so they may be broadcast."""
    total = groups.agg(F.sum(size)).first()[0] or 0
    return groups.where((F.col(size) * share > F.lit(total)) & (F.col(size) > 1))


def batches_by_bytes(batch: pa.RecordBatch, column: str, most: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about `most` bytes of a text column, one row at least, so that long texts don't pile up."""
    sizes = pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    begin = 0
    while begin < len(sizes):
        base = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield batch.slice(begin, end - begin)
        begin = end


class Bloom:
    """Bit positions of 64-bit keys in a filter of a power-of-two number of bits."""

    def __init__(self, bits: int, hashes: int):
        self.mask, self.hashes = np.uint64(bits - 1), hashes

    @staticmethod
    def sized(n: int, bits_per_key: int = 16, most_bits: int = 1 << 28, hashes: int = 4) -> "Bloom":
        """At least 2**16 bits; at most most_bits, however many keys there are."""
        bits = 1 << max(16, math.ceil(math.log2(max(1, n * bits_per_key))))
        return Bloom(min(bits, most_bits), hashes)

    @property
    def bits(self) -> int:
        return int(self.mask) + 1

    def positions(self, keys: np.ndarray) -> list[np.ndarray]:
        x = keys.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(29)
        step = (x >> np.uint64(17)) | np.uint64(1)
        return [(x + np.uint64(i) * step) & self.mask for i in range(self.hashes)]

    def has(self, plane: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """plane: the filter's bits, packed in bytes, low bit first."""
        found = np.ones(len(keys), bool)
        for p in self.positions(keys):
            found &= (plane[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return found


#: Bytes of a filter's bit plane in one row of the merge.
BLOCK = 1 << 16


def build_bloom(keys: DataFrame, bloom: Bloom, twice: bool = False) -> np.ndarray:
    """The packed bits that a one-column table of 64-bit keys sets; with twice, those that are set two times or more.

    Each task fills a filter of its own; blocks of these are merged on the executors, so the driver gets one filter of at
    most bloom.bits bits. A key that occurs twice sets all its positions twice; a key that occurs once rarely finds that.
    """
    (name,) = keys.columns
    blocks = bloom.bits // 8 // min(BLOCK, bloom.bits // 8)
    width = bloom.bits // 8 // blocks

    def put(plane: np.ndarray, p: np.ndarray) -> None:
        """Sets bits; p is sorted."""
        byte = p >> 3
        at = np.flatnonzero(np.concatenate([[True], byte[1:] != byte[:-1]]))
        plane[byte[at]] |= np.bitwise_or.reduceat(np.left_shift(1, p & 7).astype(np.uint8), at)

    def fill(batches):
        one, two = np.zeros(bloom.bits // 8, np.uint8), np.zeros(bloom.bits // 8 if twice else 0, np.uint8)
        for batch in batches:
            k = batch.column(0).drop_null().to_numpy(zero_copy_only=False)
            if not len(k):
                continue
            p = np.sort(np.concatenate(bloom.positions(k)).astype(np.int64))
            if twice:
                again = (p[1:] == p[:-1]) | ((one[p[1:] >> 3] >> (p[1:] & 7)) & 1 == 1)
                again = np.concatenate([[(one[p[0] >> 3] >> (p[0] & 7)) & 1 == 1], again])
                if again.any():
                    put(two, p[again])
            put(one, p)
        for i in range(blocks):
            part = one[i * width : (i + 1) * width]
            if part.any():
                yield pa.record_batch(
                    [pa.array([i], pa.int32()), pa.array([part.tobytes()], pa.binary()), pa.array([two[i * width : (i + 1) * width].tobytes()], pa.binary())],
                    names=["block", "one", "two"],
                )

    def merge(table: pa.Table) -> pa.Table:
        one, two = np.zeros(width, np.uint8), np.zeros(width, np.uint8)
        for a, b in zip(table["one"].to_pylist(), table["two"].to_pylist()):
            x = np.frombuffer(a, np.uint8)
            if twice:
                two |= np.frombuffer(b, np.uint8) | (one & x)
            one |= x
        return pa.table({"block": pa.array([table["block"][0].as_py()], pa.int32()), "bits": pa.array([(two if twice else one).tobytes()], pa.binary())})

    merged = keys.mapInArrow(fill, "block int, one binary, two binary").groupBy("block").applyInArrow(merge, "block int, bits binary")
    plane = np.zeros(bloom.bits // 8, np.uint8)
    for row in merged.toLocalIterator():
        plane[row.block * width : (row.block + 1) * width] = np.frombuffer(row.bits, np.uint8)
    return plane


def passing(df: DataFrame, column: str, keys: DataFrame, bits_per_key: int = 16) -> DataFrame:
    """Rows of df whose 64-bit column a filter of the one-column table of keys may hold: all that it holds, and few others."""
    bloom = Bloom.sized(keys.count(), bits_per_key)
    sent = df.sparkSession.sparkContext.broadcast(build_bloom(keys, bloom))  # of at most 32 MB

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(bloom.has(sent.value, batch[column].to_numpy())))

    return df.mapInArrow(run, df.schema)
