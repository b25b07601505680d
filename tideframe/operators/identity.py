"""What a dataset is: bounds, counts, names and hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def bounds(records: DataFrame, at: str = "at_us") -> DataFrame:
    """One row: min_us, max_us; null for an empty dataset."""
    return records.agg(F.min(at).alias("min_us"), F.max(at).alias("max_us"))


def facts(records: DataFrame, at: str = "at_us", symbol: str = "symbol", *keys: str) -> DataFrame:
    """row_count, min_us, max_us, n_symbols, symbols (sorted, comma-joined), in one pass."""
    own = records.groupBy(*keys) if keys else records
    return own.agg(F.count(F.lit(1)).alias("row_count"), F.min(at).alias("min_us"), F.max(at).alias("max_us"), F.countDistinct(symbol).alias("n_symbols"), F.concat_ws(",", F.array_sort(F.collect_set(symbol))).alias("symbols"))


def physical_hashes(spark: SparkSession, root: str, pattern: str = "*.parquet") -> DataFrame:
    """location (below root), physical_hash of every file: SHA-256 of its bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    base = root.removeprefix("file://").rstrip("/")
    below = F.substring_index("path", f"{base}/", -1)
    return files.select(below.alias("location"), F.sha2("content", 256).alias("physical_hash"))
