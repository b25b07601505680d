"""Exact duplicates by two passes over hashes with a Bloom filter.

The first pass fills a filter that keeps, for each bit, whether it was set once or twice or more. The second pass asks it of
every hash: one whose bits aren't all set twice occurs once, and its row passes straight through. Only the other rows
shuffle, to their exact hash. The filter has at most MOST_BITS bits; hashes beyond what that serves are dealt to
slices by their value, each with a filter of its own.

Texts are equal when they are the same after each run of ASCII white space became one space; null counts as empty. Of
equal rows the one with the smallest doc_id stays (null doc_ids last; of rows that repeat the doc_id, one). Empty tables give empty
results; other columns are carried or ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_RUN, Bloom, build_bloom, hot, numbered, place, plain, staged, trimmed, unstage, work_path

BITS_PER_KEY = 16
MOST_BITS = 1 << 28


def text_hash(text: str = "text") -> Column:
    """SHA-256 of the text with runs of white space as one space, in lower-case hex."""
    return F.sha2(F.regexp_replace(F.coalesce(F.col(f"`{text}`"), F.lit("")), SPACE_RUN, " ").cast("binary"), 256)


def _slices(n: int) -> int:
    return max(1, -(-n * BITS_PER_KEY // MOST_BITS))


def flag_repeated(rows: DataFrame, name: str) -> DataFrame:
    """rows (a staged table with the 64-bit key h), staged anew with `maybe`: whether the key may occur twice.

    Keys beyond what one filter serves are dealt to slices by their value, rows once to a folder for each slice; the slices
    then take their turn, so that driver and workers hold one filter of at most MOST_BITS bits at a time.
    """
    spark = rows.sparkSession
    slices = _slices(rows.count())
    if slices == 1:
        return staged(_flagged(rows, rows.select("h")), name)
    dealt, path = work_path(spark, f"{name}-slices"), work_path(spark, name)
    rows.withColumn("slice", F.pmod("h", F.lit(slices))).repartition("slice", F.pmod(F.xxhash64("h"), F.lit(64))).write.partitionBy("slice").parquet(dealt)
    schema = rows.withColumn("maybe", F.lit(True)).schema
    for i in range(slices):
        own = spark.read.schema(rows.schema).parquet(f"{dealt}/slice={i}")
        _flagged(own, own.select("h")).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def _flagged(rows: DataFrame, keys: DataFrame) -> DataFrame:
    bloom = Bloom.sized(keys.count(), BITS_PER_KEY, MOST_BITS)
    sent = rows.sparkSession.sparkContext.broadcast(build_bloom(keys, bloom, twice=True))

    def run(batches):
        for batch in batches:
            found = bloom.has(sent.value, batch["h"].to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], names=[*batch.schema.names, "maybe"])
        trimmed()

    return rows.mapInArrow(run, rows.withColumn("maybe", F.lit(True)).schema)


def repeated_filter(keys: DataFrame, name: str) -> tuple[Bloom, np.ndarray]:
    """A filter that holds every key (column h of a staged table) that occurs twice, and few others; of at most MOST_BITS bits."""
    n = keys.count()
    if _slices(n) == 1:
        bloom = Bloom.sized(n, BITS_PER_KEY, MOST_BITS)
        return bloom, build_bloom(keys, bloom, twice=True)
    again = flag_repeated(keys, name).where("maybe").select("h")
    bloom = Bloom.sized(again.count(), BITS_PER_KEY, MOST_BITS)
    return bloom, build_bloom(again, bloom)


def _groups(flagged: DataFrame) -> DataFrame:
    """Of each hash among the rows that may repeat: its first row, and how many rows have it."""
    best = F.min(F.struct(F.col("doc_id").isNull().alias("void"), "doc_id", "row"))
    return flagged.where("maybe").groupBy("sha").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size"))


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    hashed = plain(docs, "doc_id", "text").select("doc_id", F.unhex(text_hash()).alias("sha")).withColumn("h", F.xxhash64("sha")).withColumn("row", F.monotonically_increasing_id())
    hashed = staged(hashed, "hashes")
    flagged = flag_repeated(hashed, "flagged-hashes")
    groups = staged(_groups(flagged), "hash-groups")
    unstage(hashed)
    # Groups with more than a thousandth of the rows are fewer than that and go to all their rows; only rows of the others meet by shuffle.
    large = F.broadcast(hot(groups, "group_size").withColumnRenamed("best", "at").withColumnRenamed("group_size", "large_size"))
    met = flagged.where("maybe").join(large, "sha", "left")
    found = lambda df, size: df.select("doc_id", F.col("best.doc_id").alias("keep_id"), F.col(size).alias("group_size"), (F.col("best.row") == F.col("row")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
    done = found(met.where("at is not null").withColumnRenamed("at", "best"), "large_size")
    shuffled = found(met.where("at is null").select("sha", "doc_id", "row").join(groups, "sha"), "group_size")
    through = flagged.where("not maybe").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
    return through.unionByName(done).unionByName(shuffled)


def keep_first(docs: DataFrame) -> DataFrame:
    """docs without the rows that exact_duplicates() drops, all columns as they were.

    Texts are never shuffled: what goes is named by hash and doc_id, and rows that a filter of repeated hashes doesn't hold pass by.
    """
    columns = numbered(docs).withColumn("sha", F.unhex(text_hash(place(docs, "text")))).withColumn("h", F.xxhash64("sha"))
    keys = staged(columns.select(F.col(place(docs, "doc_id")).alias("doc_id"), "sha", "h", F.monotonically_increasing_id().alias("row")), "hashes")
    groups = staged(_groups(flag_repeated(keys, "flagged-hashes")).where("group_size > 1"), "repeated-groups")
    bloom = Bloom.sized(groups.count(), 24, MOST_BITS)
    sent = docs.sparkSession.sparkContext.broadcast(build_bloom(groups.select(F.xxhash64("sha").alias("h")), bloom))

    def split(wanted: bool):
        def run(batches):
            for batch in batches:
                found = bloom.has(sent.value, batch["h"].to_numpy())
                yield batch.filter(pa.array(found if wanted else ~found))

        return columns.mapInArrow(run, columns.schema)

    own = groups.select("sha", F.col("best.doc_id").alias("keep_id"), F.lit(True).alias("met"))
    # A copy that isn't its group's first goes before anything moves where its group is large; the others meet by shuffle.
    large = F.broadcast(hot(groups, "group_size").select("sha", F.col("best.doc_id").alias("large_id"), F.lit(True).alias("large")))
    doc_id = F.col(place(docs, "doc_id"))
    some = split(True).join(large, "sha", "left").where("large is null or large_id <=> " + place(docs, "doc_id")).drop("large", "large_id")
    met = some.join(own, "sha", "left")
    # A hash that the filter only seemed to know has no group and stays; of rows that repeat the smallest doc_id, one stays.
    alone = met.where("met is null")
    first = met.where(F.col("met") & F.col("keep_id").eqNullSafe(doc_id)).dropDuplicates(["sha"])
    out = [df.drop("sha", "h", "keep_id", "met") for df in (split(False), alone, first)]
    return out[0].unionByName(out[1]).unionByName(out[2]).toDF(*docs.columns)
