"""Replay: every observation that becomes available at one instant, in one frame, in a canonical order.

A source is a DataFrame of source (its manifest's digest), ordinal (place in stored order), at_us (availability), record_type
and further columns. Ordinals are never renumbered; ranges select after the checks.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as E
from ..functions import files
from ..schemas import VERSION
from . import catalog as G
from . import storage
from .cut import materialized
from .ordering import with_previous


class ReplayError(ValueError):
    """A set of sources that can't be replayed."""


class UnsupportedSchema(ReplayError):
    """A source of another storage version."""


class DuplicateSemantics(ReplayError):
    """Two sources with the same contents."""


class NonMonotonic(ReplayError):
    """A source whose stored order goes back in time."""


class AmbiguousOverlap(ReplayError):
    """Two sources of one contract and type whose selected spans touch."""


@dataclass(frozen=True)
class ReplayConfig:
    """A non-empty set of manifest hashes and a half-open range in microseconds; None is unbounded."""

    manifests: tuple[str, ...]
    start: int | None = None
    end: int | None = None

    def __post_init__(self) -> None:
        if not self.manifests or len(set(self.manifests)) < len(self.manifests):
            raise ValueError("manifest hashes must be some, and each one once")
        if self.start is not None and self.end is not None and self.end <= self.start:
            raise ValueError("a range ends after it starts")
        object.__setattr__(self, "manifests", tuple(sorted(self.manifests)))


def union_sources(sources: Sequence[DataFrame]) -> DataFrame:
    """Trades, quotes and bars in one table; columns that a type lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources)


def select_range(rows: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    return rows.where(E.in_range(F.col("at_us"), start, end))


def steps_back(rows: DataFrame) -> DataFrame:
    """source, ordinal, at_us, previous of rows before which the stored order goes back."""
    return with_previous(rows.select("source", "ordinal", "at_us"), "at_us", "ordinal", "source").where("previous > at_us")


def spans(rows: DataFrame) -> DataFrame:
    """source, lo, hi of what is selected; a source without rows has no span and overlaps nothing."""
    return rows.groupBy("source").agg(F.min("at_us").alias("lo"), F.max("at_us").alias("hi"))


def duplicate_semantics(manifests: DataFrame) -> DataFrame:
    """semantic_hash, sources of contents that more than one manifest (source, semantic_hash) has."""
    return manifests.groupBy("semantic_hash").agg(F.array_sort(F.collect_set("source")).alias("sources")).where(F.size("sources") > 1)


def overlaps(described: DataFrame) -> DataFrame:
    """a, b of sources (source, contract, record_type, lo, hi) of one contract and type whose closed spans meet. Sources are files of a replay, not rows."""
    one, two = described.alias("x"), described.alias("y")
    same = (F.col("x.contract") == F.col("y.contract")) & (F.col("x.record_type") == F.col("y.record_type")) & (F.col("x.source") < F.col("y.source"))
    meet = (F.col("x.hi") >= F.col("y.lo")) & (F.col("y.hi") >= F.col("x.lo"))
    return one.join(two, same & meet).select(F.col("x.source").alias("a"), F.col("y.source").alias("b"))


def prepare(sources: Sequence[DataFrame], manifests: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """The selected rows of all sources, or the error that forbids to replay them; checks on whole sources come before the range.

    manifests: source, semantic_hash, contract, record_type, schema_version.
    """
    old = manifests.where("schema_version <> 3").take(1)
    if old:
        raise UnsupportedSchema(f"{old[0].source} has storage version {old[0].schema_version}")
    rows = union_sources(sources)
    back = steps_back(rows).take(1)
    if back:
        raise NonMonotonic(f"row {back[0].ordinal} of {back[0].source} lies before the row stored before it")
    twice = duplicate_semantics(manifests).take(1)
    if twice:
        raise DuplicateSemantics(f"the same contents: {', '.join(twice[0].sources)}")
    chosen = select_range(rows, start, end)
    met = overlaps(spans(chosen).join(manifests.select("source", "contract", "record_type"), "source")).take(1)
    if met:
        raise AmbiguousOverlap(f"{met[0].a} and {met[0].b}")
    return chosen


#: Failures of a source's copies, the one that says most last.
SEVERITY = (G.MissingArtifact, G.PhysicalMismatch, G.SchemaMismatch, G.SemanticMismatch)


def load_source(spark: SparkSession, root: str, storage_root: str, digest: str) -> tuple[DataFrame, dict[str, Any]]:
    """(rows with source, ordinal, at_us, record_type and the record's own columns; manifest) of a published dataset.

    Every copy that the index knows is tried in the order of locations, and the first that meets all claims is taken; where none does, the
    failure that says most is raised. The rows are kept, and hashed again as they were kept: what was verified is what is replayed.
    Ordinals are places in stored order.
    """
    manifest = G.read_manifest(root, digest)
    if manifest["schema_version"] != VERSION:
        raise UnsupportedSchema(f"{digest} has storage version {manifest['schema_version']}")
    worst: G.CatalogError = G.MissingArtifact(f"no copy of {digest}")
    for location, _ in sorted(e for e in G.load_index(root) if e[1] == manifest["physical_hash"]):
        path = files.join(storage_root, location)
        try:
            G.verify_artifact(spark, path, manifest)
            records, _ = storage.read_artifact(spark, path, manifest["contract"], manifest["record_type"])
            kept = materialized(records)
            if G.semantic_hash_of(kept, manifest["record_type"], manifest["contract"]) != manifest["semantic_hash"]:
                raise G.SemanticMismatch(f"{path} changed while it was read")
        except SEVERITY as e:
            worst = max(worst, e, key=lambda x: SEVERITY.index(type(x)))
            continue
        own = kept.select(F.lit(digest).alias("source"), F.lit(manifest["record_type"]).alias("record_type"), *kept.columns)
        return own, manifest
    raise worst


def prepare_from_catalog(spark: SparkSession, root: str, storage_root: str, config: ReplayConfig) -> DataFrame:
    """The selected rows of all datasets that a configuration names, or the error that forbids to replay them: all or none."""
    loaded = [load_source(spark, root, storage_root, digest) for digest in config.manifests]
    about = [(m["manifest_hash"], m["semantic_hash"], m["contract"], m["record_type"], m["schema_version"]) for _, m in loaded]
    described = spark.createDataFrame(about, "source string, semantic_hash string, contract string, record_type string, schema_version int")
    return prepare([rows for rows, _ in loaded], described, config.start, config.end)


def frames(rows: DataFrame, *columns: str) -> DataFrame:
    """at_us, events: what becomes available at each instant, by source and ordinal. A frame is as large as its instant."""
    event = F.struct("source", "ordinal", "record_type", *columns)
    return rows.groupBy("at_us").agg(F.array_sort(F.collect_list(event)).alias("events"))


def frame_summary(rows: DataFrame) -> DataFrame:
    """Counts and totals of frames, aggregated before rows move: at_us, n_events, first_ordinal, last_ordinal, volume, notional."""
    return rows.groupBy("at_us").agg(
        F.count(F.lit(1)).alias("n_events"),
        F.min("ordinal").alias("first_ordinal"),
        F.max("ordinal").alias("last_ordinal"),
        F.sum("size").cast("bigint").alias("volume"),
        F.sum(F.col("price_fp") * F.col("size")).cast("bigint").alias("notional_fp"),
    )


def positions(rows: DataFrame) -> DataFrame:
    """rows with frame_position, each event's place in its frame."""
    from pyspark.sql import Window

    return rows.withColumn("frame_position", F.row_number().over(Window.partitionBy("at_us").orderBy("source", "ordinal")).cast("bigint") - 1)


def broken_invariants(rows: DataFrame) -> DataFrame:
    """source, ordinal of events that a frame would hold twice."""
    return rows.groupBy("at_us", "source", "ordinal").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def frame_digest(framed: DataFrame) -> str:
    """SHA-256 over the frames in order, one partition at a time."""
    import hashlib

    out = hashlib.sha256()
    for r in framed.orderBy("at_us").select(F.to_json(F.struct("at_us", "events")).alias("j")).toLocalIterator():
        out.update(r.j.encode() + b"\n")
    return out.hexdigest()
