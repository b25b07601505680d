"""Replay as a stream: frames of simultaneous events from micro-batches, sources that go back refused."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_events(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def frames(events: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """events (timestamp, source, ordinal, size): timestamp, n_events, first_ordinal, last_ordinal, volume, once the watermark passed an instant.

    Instants are kept to the microsecond; the watermark counts milliseconds, so frames of the last one wait for later data. Sources don't go back, so no event comes behind the watermark; run_to_table() fails if one did.
    """
    own = events.withWatermark("timestamp", delay).groupBy("timestamp")
    return own.agg(F.count(F.lit(1)).alias("n_events"), F.min("ordinal").alias("first_ordinal"), F.max("ordinal").alias("last_ordinal"), F.sum("size").cast("bigint").alias("volume"))


def steps_back(events: DataFrame) -> DataFrame:
    """source, ordinal, at_us, previous of events before which their source goes back, across micro-batches; the state is a source's last instant and ordinal."""

    def check(key: tuple[Any, ...], chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(chunks)).sort_values("ordinal", ignore_index=True)
        last = state.get[0] if state.exists else None
        before = rows["at_us"].shift(1)
        if len(rows):
            before.iloc[0] = last
        back = before.notna() & (before > rows["at_us"])
        if len(rows):
            state.update((int(rows["at_us"].iloc[-1]),))
        out = rows[back].copy()
        out["previous"] = before[back].astype("int64")
        yield out[["source", "ordinal", "at_us", "previous"]]

    own = events.select("source", "ordinal", F.unix_micros("timestamp").alias("at_us"))
    return own.groupBy("source").applyInPandasWithState(check, "source string, ordinal bigint, at_us bigint, previous bigint", "last bigint", "append", GroupStateTimeout.NoTimeout)


def deduplicated_quotes(quotes: DataFrame, delay: str = "1 minute") -> DataFrame:
    """Quotes that repeat an earlier one in all fields go; trades never do."""
    return quotes.withWatermark("timestamp", delay).dropDuplicatesWithinWatermark(["timestamp", "instrument_symbol", "bid", "ask", "bid_size", "ask_size"])


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Drives a stream over what is there now into a table at path, which executors write; fails if the watermark dropped rows."""
    query = stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    dropped = sum(s.get("numRowsDroppedByWatermark", 0) for p in query.recentProgress for s in p["stateOperators"])
    if dropped:
        raise ValueError(f"{dropped} events came behind the watermark")
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
