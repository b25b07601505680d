"""Canonical bytes of records and datasets, as JVM expressions."""

from __future__ import annotations

import hashlib
import json
import struct
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


from ..schemas import SIDES

# Fixed values of the identity format: its name, and each record type's fields in order.
SEMANTIC_FORMAT = "qrt-semantic-dataset/1"
TOKENS = {
    "trade": "trade/timestamp:price:size:side",
    "quote": "quote/timestamp:bid:ask:bid_size:ask_size",
    "bar": "bar/timestamp:interval:open:high:low:close:volume",
}


def be8(value: Column) -> Column:
    """Eight bytes, big-endian, of an integer: signed, or unsigned of 2**63 or more."""
    wide = value.cast("decimal(20,0)")
    folded = F.when(wide >= F.lit(str(2**63)).cast("decimal(20,0)"), wide - F.lit(str(2**64)).cast("decimal(20,0)")).otherwise(wide)
    return F.unhex(F.lpad(F.hex(folded.cast("bigint")), 16, "0"))


def record_bytes(record_type: str, c: dict[str, Column]) -> Column:
    """A record's canonical bytes; prices as fixed-point integers, instants and intervals in microseconds."""
    if record_type == "trade":
        side = F.unhex(F.concat(*[F.when(c["side"] == s, F.lit(f"0{i}")).otherwise(F.lit("")) for i, s in enumerate(SIDES)]))
        return F.concat(be8(c["timestamp"]), be8(c["price"]), be8(c["size"]), side)
    names = ["timestamp", "bid", "ask", "bid_size", "ask_size"] if record_type == "quote" else ["timestamp", "interval", "open", "high", "low", "close", "volume"]
    return F.concat(*[be8(c[n]) for n in names])


def frame(text: str) -> bytes:
    raw = text.encode()
    return struct.pack(">I", len(raw)) + raw


def header(record_type: str, contract: str) -> bytes:
    return b"".join(map(frame, (SEMANTIC_FORMAT, record_type, TOKENS[record_type], contract)))


def semantic_hash(records: DataFrame, record_type: str, contract: str, order: str = "ordinal", raw: str = "raw") -> DataFrame:
    """One row: semantic_hash, row_count, of records' bytes in order.

    SHA-256 is a chain over the stored order. All executors sort; one task takes the sorted ranges one after the other and holds a batch of
    rows at a time, so neither it nor the driver grows with the dataset.
    """
    begin = header(record_type, contract)

    def digest(batches):
        import pyarrow as pa

        out, n = hashlib.sha256(begin), 0
        for batch in batches:
            for value in batch.column(0).to_pylist():
                out.update(value)
            n += batch.num_rows
        out.update(struct.pack(">Q", n))
        yield pa.record_batch([pa.array([out.hexdigest()]), pa.array([n], pa.int64())], names=["semantic_hash", "row_count"])

    ranged = records.select(order, raw).repartitionByRange(order).sortWithinPartitions(order).select(raw)
    found = ranged.coalesce(1).mapInArrow(digest, "semantic_hash string, row_count bigint")
    # No rows, no task: the digest of nothing.
    none = hashlib.sha256(begin + struct.pack(">Q", 0)).hexdigest()
    return found.agg(F.coalesce(F.first("semantic_hash"), F.lit(none)).alias("semantic_hash"), F.coalesce(F.first("row_count"), F.lit(0)).cast("bigint").alias("row_count"))


def stream_hash(records: DataFrame, record_type: str, contract: str, order: str = "ordinal", raw: str = "raw") -> str:
    """The digest alone, on the driver."""
    return semantic_hash(records, record_type, contract, order, raw).first().semantic_hash


def canonical_json(payload: Any) -> bytes:
    """Sorted keys, no white space, ASCII."""
    return json.dumps(payload, sort_keys=True, separators=(",", ":"), ensure_ascii=True, allow_nan=False).encode("ascii")


def content_hash(payload: Any) -> str:
    return hashlib.sha256(canonical_json(payload)).hexdigest()


