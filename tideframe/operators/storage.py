"""Stored artifacts: one Parquet file for a dataset, whose bytes and footer are part of the contract.

Spark can't write unsigned integers or footer metadata, so a single-file artifact is written through pyarrow in a task, row group by
row group, from rows that reach it in stored order. Reading is Spark's own; the footer is read on the driver. Paths may be URIs.
"""

from __future__ import annotations

import hashlib
import uuid

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as E
from ..functions import files
from ..schemas import EARLIEST, LATEST, LEGACY_VERSION, PRICE_PRECISION, PRICE_SCALE, PRICES, QUANTITIES, ROW_GROUP, SCHEMA_NAME, SIDES, STORED, VERSION


class StorageError(ValueError):
    """A file that isn't there or can't be read."""


class StorageContractError(StorageError):
    """A file whose schema, metadata or rows break the contract."""


def metadata(kind: str, version: int, contract: str | None) -> dict[str, str]:
    out = {"schema_name": SCHEMA_NAME, "schema_version": str(version), "timestamp_timezone": "UTC", "price_encoding": "fixed_scale_decimal", "price_precision": str(PRICE_PRECISION), "price_scale": str(PRICE_SCALE)}
    return out | ({"record_type": kind, "canonical_identity": contract or ""} if version == VERSION else {})


def arrow_schema(kind: str, version: int = VERSION, contract: str | None = None) -> pa.Schema:
    names = [("timestamp", pa.timestamp("us", tz="UTC"))]
    names += [("canonical_identity", pa.string()), ("vendor_symbol", pa.string())] if version == VERSION else [("instrument_symbol", pa.string())]
    names += [(n, {"int64": pa.int64(), "uint64": pa.uint64(), "string": pa.string()}[t]) for n, t in STORED[kind]]
    return pa.schema([pa.field(n, t) for n, t in names], metadata=metadata(kind, version, contract))


def stored_rows(records: DataFrame, kind: str, contract: str | None = None) -> DataFrame:
    """Records (ordinal, at_us, symbol, decimal prices and quantities, side, interval_us) as storage columns, prices in fixed point."""
    cols = [F.col("ordinal"), F.col("at_us").alias("timestamp")]
    cols += [F.lit(contract).alias("canonical_identity"), F.col("symbol").alias("vendor_symbol")] if contract else [F.col("symbol").alias("instrument_symbol")]
    for n, _ in STORED[kind]:
        if n in PRICES[kind]:
            cols.append(E.fixed_point(F.col(n)).alias(n))
        elif n in QUANTITIES[kind]:
            cols.append(F.col(n).cast("decimal(20,0)").alias(n))
        elif n == "interval_microseconds":
            cols.append(F.col("interval_us").cast("decimal(20,0)").alias(n))
        else:
            cols.append(F.col(n))
    return records.select(*cols)


def write_artifact(rows: DataFrame, path: str, kind: str, version: int = VERSION, contract: str | None = None) -> None:
    """stored_rows() in order of ordinal, as one file that appears whole or not at all.

    Rows are sorted by all executors; the one task that writes the file takes the sorted ranges one after the other, a row group at a time.
    An attempt that is lost leaves a partial file of its own name behind, and never the artifact.
    """
    schema = arrow_schema(kind, version, contract)

    def write(batches):
        from pyspark import TaskContext

        partial = f"{path}.{uuid.uuid4().hex}-{TaskContext.get().taskAttemptId()}.partial"
        _write(batches, partial, schema)
        yield pa.record_batch([pa.array([partial])], names=["partial"])

    ordered = rows.select("ordinal", *schema.names).repartitionByRange("ordinal").sortWithinPartitions("ordinal").drop("ordinal")
    made = [r.partial for r in ordered.coalesce(1).mapInArrow(write, "partial string").collect()]
    if not made:  # nothing to write, no task to write it
        made = [f"{path}.{uuid.uuid4().hex}.partial"]
        _write([], made[0], schema)
    files.move(made[0], path)


def _write(batches, path: str, schema: pa.Schema) -> None:
    fs, own = files.at(path)
    with fs.open_output_stream(own) as out, pq.ParquetWriter(out, schema, compression="snappy", use_dictionary=False, version="2.6") as writer:
        held: list[pa.Table] = []
        for batch in batches:
            held.append(pa.Table.from_arrays([batch[f.name].cast(f.type) for f in schema], schema=schema))
            if sum(t.num_rows for t in held) >= ROW_GROUP:
                table = pa.concat_tables(held)
                whole = table.num_rows // ROW_GROUP * ROW_GROUP
                writer.write_table(table.slice(0, whole), row_group_size=ROW_GROUP)
                held = [table.slice(whole)] if whole < table.num_rows else []
        if held:
            writer.write_table(pa.concat_tables(held), row_group_size=ROW_GROUP)


def _footer(path: str) -> pa.Schema:
    fs, own = files.at(path)
    with fs.open_input_file(own) as f:
        return pq.read_schema(f)


def descriptor(path: str) -> dict[str, str]:
    """The footer's metadata; no rows are read."""
    try:
        found = _footer(path)
    except FileNotFoundError as e:
        raise StorageError(f"no artifact at {path}") from e
    except pa.ArrowInvalid as e:
        raise StorageContractError(f"not an artifact: {path}") from e
    return {k.decode(): v.decode() for k, v in (found.metadata or {}).items() if k != b"ARROW:schema"}


def read_artifact(spark: SparkSession, path: str, contract: str | None = None, kind: str | None = None) -> tuple[DataFrame, dict[str, str]]:
    """(records with ordinal, at_us, symbol, decimals, descriptor), in stored order by ordinal. The schema, the metadata, every null,
    and every row's identity are held against the contract."""
    found = descriptor(path)
    version = int(found.get("schema_version", 0))
    own = found.get("record_type", kind)
    if version not in (LEGACY_VERSION, VERSION) or own not in STORED or kind not in (None, own):
        raise StorageContractError(f"{path}: version {found.get('schema_version')}, record type {own}")
    held = found.get("canonical_identity")
    if found != metadata(own, version, held):
        raise StorageContractError(f"{path}: metadata {found}")
    if contract is not None and held != contract:
        raise StorageContractError(f"{path} holds {held}, not {contract}")
    schema = arrow_schema(own, version, held)
    if [(f.name, f.type) for f in _footer(path)] != [(f.name, f.type) for f in schema]:
        raise StorageContractError(f"{path}: columns")
    raw = spark.read.parquet(path)
    checks = [F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in raw.columns]
    if version == VERSION:
        checks.append(F.count_if(F.col("canonical_identity") != held).alias("foreign"))
    # What no valid record holds: instants beyond the years 1 to 9999, prices and quantities outside their envelope, unknown sides.
    at = F.unix_micros("timestamp")
    checks.append(F.count_if((at < EARLIEST) | (at > LATEST)).alias("range_timestamp"))
    for n, _ in STORED[own]:
        if n in PRICES[own]:
            checks.append(F.count_if((F.col(n) <= 0) | (F.col(n) > 10**18 - 1)).alias(f"range_{n}"))
        elif n in QUANTITIES[own] or n == "interval_microseconds":
            checks.append(F.count_if(F.col(n) < 1).alias(f"range_{n}"))
        else:
            checks.append(F.count_if(~F.col(n).isin(*SIDES)).alias(f"range_{n}"))
    wrong = {k: v for k, v in raw.agg(*checks).first().asDict().items() if v}
    if wrong:
        raise StorageContractError(f"{path}: {wrong}")
    return decoded(raw.withColumn("ordinal", F.col("_metadata.row_index")), own, version), found


def decoded(raw: DataFrame, kind: str, version: int = VERSION) -> DataFrame:
    cols = [F.col("ordinal"), F.unix_micros("timestamp").alias("at_us"), F.col("vendor_symbol" if version == VERSION else "instrument_symbol").alias("symbol")]
    for n, _ in STORED[kind]:
        if n in PRICES[kind]:
            cols.append(E.from_fixed_point(F.col(n)).alias(n))
        elif n == "interval_microseconds":
            cols += [F.col(n).cast("bigint").alias("interval_us"), (F.unix_micros("timestamp") - F.col(n).cast("bigint")).alias("start_us")]
        else:
            cols.append(F.col(n))
    return raw.select(*cols)


def physical_hash(path: str) -> str:
    out = hashlib.sha256()
    fs, own = files.at(path)
    with fs.open_input_stream(own) as f:
        while chunk := f.read(1 << 20):
            out.update(chunk)
    return out.hexdigest()
