"""Manifests, the index of locations, verification, migration between storage versions, and the import of one dataset."""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
from dataclasses import dataclass
from typing import Any

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import files
from ..functions.encoding import canonical_json, record_bytes, stream_hash
from ..schemas import PRICES, STORED, VERSION
from . import storage, validate
from .identity import physical_hashes

# Fixed format names.
MANIFEST_FORMAT = "qrt-dataset-manifest/1"
INDEX_FORMAT = "qrt-catalog-index/2"
#: Outcomes of a verification, best first; of several copies the best counts, and a semantic mismatch is worse news than none.
OUTCOMES = ("ok", "semantic_mismatch", "physical_mismatch", "missing_artifact", "missing_manifest")


class CatalogError(ValueError):
    """Something in a catalog that isn't what it should be."""


class MissingManifest(CatalogError):
    """No manifest of that hash."""


class MissingArtifact(CatalogError):
    """No file at a location."""


class ManifestHashMismatch(CatalogError):
    """A manifest that isn't what its name says."""


class SemanticMismatch(CatalogError):
    """A file whose contents aren't those of its manifest."""


class PhysicalMismatch(CatalogError):
    """A file whose bytes aren't those of its manifest."""


class SchemaMismatch(CatalogError):
    """A file of another version, record type or contract than its manifest."""


class Conflict(CatalogError):
    """A name that is taken by other bytes."""


class OutsideRoot(CatalogError):
    """A location that leaves its root."""


class Migration(CatalogError):
    """A mapping of symbols that doesn't fit the dataset."""


class ImportFailed(ValueError):
    """A batch with errors; nothing was written."""


class ReadBackFailed(ValueError):
    """What was written isn't what was to be written."""


# Fixed tokens of how a dataset came about.
ORIGINS = ("imported", "migrated-from-v2")
TRANSFORMATIONS = ("none", "symbol-mapping")


def source_provenance(origin: str, provider_token: str | None = None, source_artifact_hash: str | None = None, vendor_symbols: tuple[str, ...] = ()) -> dict[str, Any]:
    """Where a dataset's rows come from; symbols are listed once each, sorted, so that row order can't show."""
    if origin not in ORIGINS or provider_token is not None and not re.fullmatch("[A-Z0-9_]{1,32}", provider_token):
        raise ValueError(f"origin {origin!r} or provider token {provider_token!r}")
    if source_artifact_hash is not None and not re.fullmatch("[0-9a-f]{64}", source_artifact_hash):
        raise ValueError(f"not a digest: {source_artifact_hash!r}")
    if any(not v.strip() for v in vendor_symbols):
        raise ValueError("a blank vendor symbol")
    return {"origin": origin, "provider_token": provider_token, "source_artifact_hash": source_artifact_hash, "vendor_symbols": sorted(set(vendor_symbols))}


def transformation(kind: str = "none", mapping: dict[str, str] | None = None, source_schema_version: int | None = None) -> dict[str, Any]:
    """What was done to the rows; only a mapping has pairs, sorted by symbol, and one of an empty dataset may have none."""
    if kind not in TRANSFORMATIONS or kind == "none" and mapping:
        raise ValueError(f"transformation {kind!r} with {mapping}")
    return {"kind": kind, "symbol_mapping": [[k, validate_contract(v)] for k, v in sorted((mapping or {}).items())], "source_schema_version": source_schema_version}


def semantic_columns(kind: str) -> dict[str, Any]:
    cols = {"timestamp": F.col("at_us"), "interval": F.col("interval_us") if kind == "bar" else F.lit(None)}
    for n, _ in STORED[kind]:
        cols[n] = (F.col(n) * 1_000_000).cast("bigint") if n in PRICES[kind] else F.col("interval_us") if n == "interval_microseconds" else F.col(n)
    return cols


def semantic_hash_of(records: DataFrame, kind: str, contract: str) -> str:
    return stream_hash(records.select("ordinal", record_bytes(kind, semantic_columns(kind)).alias("raw")), kind, contract)


def describe(records: DataFrame) -> dict[str, Any]:
    r = records.agg(F.count(F.lit(1)).alias("n"), F.min("at_us").alias("lo"), F.max("at_us").alias("hi"), F.array_sort(F.collect_set("symbol")).alias("symbols")).first()
    return {"row_count": r.n, "min_timestamp": r.lo, "max_timestamp": r.hi, "symbols": list(r.symbols)}


def build_manifest(spark: SparkSession, path: str, source: dict[str, Any], transformed: dict[str, Any] | None = None) -> dict[str, Any]:
    """The manifest of an artifact; its hash covers all but itself, and no location. Vendor symbols are read from the rows."""
    records, found = storage.read_artifact(spark, path)
    if int(found["schema_version"]) != VERSION:
        raise SchemaMismatch(f"{path} has storage version {found['schema_version']}")
    facts = describe(records)
    payload = {
        "format": MANIFEST_FORMAT,
        "semantic_hash": semantic_hash_of(records, found["record_type"], found["canonical_identity"]),
        "physical_hash": storage.physical_hash(path),
        "schema_version": VERSION,
        "record_type": found["record_type"],
        "contract": found["canonical_identity"],
        "row_count": facts["row_count"],
        "min_timestamp": facts["min_timestamp"],
        "max_timestamp": facts["max_timestamp"],
        "source": source | {"vendor_symbols": facts["symbols"]},
        "transformation": transformed or transformation(),
    }
    return payload | {"manifest_hash": manifest_hash(payload)}


def manifest_hash(payload: dict[str, Any]) -> str:
    return hashlib.sha256(canonical_json({k: v for k, v in payload.items() if k != "manifest_hash"})).hexdigest()


def parse_manifest(raw: bytes) -> dict[str, Any]:
    """A manifest that is, byte for byte, what it would be written as."""
    try:
        out = json.loads(raw)
        same = canonical_json(out) == raw and out["manifest_hash"] == manifest_hash(out) and out["format"] == MANIFEST_FORMAT
    except (ValueError, KeyError, TypeError) as e:
        raise ManifestHashMismatch(f"unreadable manifest: {e}") from e
    if not same or (out["min_timestamp"] is None) != (out["row_count"] == 0) or (out["min_timestamp"] or 0) > (out["max_timestamp"] or 0):
        raise ManifestHashMismatch("the manifest isn't in canonical form, its hash differs, or its bounds can't be")
    return out


def publish(path: str, payload: bytes) -> bool:
    """Writes a document under its own name; the same bytes again are no change (False), others are refused."""
    if files.exists(path):
        if files.read(path) != payload:
            raise Conflict(path)
        return False
    files.write(path, payload)
    return True


def manifest_path(root: str, digest: str) -> str:
    return files.join(root, "manifests", f"{digest}.json")


def read_manifest(root: str, digest: str) -> dict[str, Any]:
    path = manifest_path(root, digest)
    if not files.exists(path):
        raise MissingManifest(digest)
    out = parse_manifest(files.read(path))
    if out["manifest_hash"] != digest:
        raise ManifestHashMismatch(digest)
    return out


def manifests(spark: SparkSession, root: str) -> DataFrame:
    """All published manifests, by hash: manifest_hash, semantic_hash, physical_hash, record_type, contract, row_count, schema_version."""
    raw = spark.read.option("wholetext", "true").option("pathGlobFilter", "*.json").text(files.join(root, "manifests"))
    schema = "manifest_hash string, semantic_hash string, physical_hash string, record_type string, contract string, row_count bigint, schema_version int, min_timestamp bigint, max_timestamp bigint"
    return raw.select(F.from_json("value", schema).alias("m")).select("m.*").orderBy("manifest_hash")


def index_document(entries: list[tuple[str, str]]) -> bytes:
    """entries of (location, physical_hash), one for a location."""
    seen = dict(entries)
    if len(seen) < len(set(entries)):
        raise Conflict("a location with two hashes")
    return canonical_json({"format": INDEX_FORMAT, "entries": [{"location": k, "physical_hash": v} for k, v in sorted(seen.items())]})


def parse_index(raw: bytes) -> list[tuple[str, str]]:
    try:
        doc = json.loads(raw.decode("ascii"))
        if doc["format"] != INDEX_FORMAT:
            raise KeyError(doc["format"])
        return [(e["location"], e["physical_hash"]) for e in doc["entries"]]
    except (ValueError, KeyError, TypeError) as e:
        raise CatalogError(f"unreadable index: {e}") from e


def load_index(root: str) -> list[tuple[str, str]]:
    path = files.join(root, "index.json")
    return parse_index(files.read(path)) if files.exists(path) else []


def write_index(root: str, entries: list[tuple[str, str]]) -> None:
    files.write(files.join(root, "index.json"), index_document(entries))


def with_entry(entries: list[tuple[str, str]], location: str, digest: str) -> list[tuple[str, str]]:
    held = dict(entries)
    if held.get(location, digest) != digest:
        raise Conflict(f"{location} holds other bytes")
    return sorted((held | {location: digest}).items())


def without_location(entries: list[tuple[str, str]], location: str) -> list[tuple[str, str]]:
    return [e for e in entries if e[0] != location]


def find_by_location(entries: list[tuple[str, str]], location: str) -> tuple[str, str] | None:
    """The entry (location, physical_hash) of a location, or None."""
    return next((e for e in entries if e[0] == location), None)


def entries_frame(spark: SparkSession, root: str) -> DataFrame:
    """The index as a table: location, physical_hash."""
    raw = spark.read.option("wholetext", "true").text(files.join(root, "index.json"))
    listed = raw.select(F.from_json("value", "format string, entries array<struct<location: string, physical_hash: string>>").alias("d"))
    return listed.select(F.explode("d.entries").alias("e")).select("e.location", "e.physical_hash")


def located(entries: DataFrame, locations: DataFrame) -> DataFrame:
    """location, physical_hash (null where the index has no entry) of many locations."""
    return locations.select("location").distinct().join(entries, "location", "left")


def location_of(storage_root: str, path: str) -> str:
    """Where a file lies below its root; one that leaves it is refused."""
    (fs, root), (other, own) = (files.at(x) for x in (storage_root, path))
    root, own = (os.path.realpath(x) if x.startswith("/") and isinstance(fs, pafs.LocalFileSystem) else os.path.normpath(x) for x in (root, own))
    if fs != other or not own.startswith(f"{root}/"):
        raise OutsideRoot(path)
    return own[len(root) + 1 :]


def register(spark: SparkSession, root: str, storage_root: str, path: str, manifest: dict[str, Any]) -> str:
    """registered or already_registered, after the artifact met all claims of its manifest."""
    location = location_of(storage_root, path)
    verify_artifact(spark, path, manifest)
    entries = with_entry(load_index(root), location, manifest["physical_hash"])
    new = publish(manifest_path(root, manifest["manifest_hash"]), canonical_json(manifest))
    changed = entries != load_index(root)
    write_index(root, entries)
    return "registered" if new or changed else "already_registered"


def verify_artifact(spark: SparkSession, path: str, manifest: dict[str, Any]) -> None:
    """Claim by claim, the cheap ones first; the first that fails is raised by its own type."""
    if not files.exists(path):
        raise MissingArtifact(path)
    if storage.physical_hash(path) != manifest["physical_hash"]:
        raise PhysicalMismatch(path)
    records, found = storage.read_artifact(spark, path)
    for key, name in (("record_type", "record_type"), ("contract", "canonical_identity"), ("schema_version", "schema_version")):
        if str(manifest[key]) != found.get(name):
            raise SchemaMismatch(f"{path}: {key}")
    facts = describe(records)
    for key in ("row_count", "min_timestamp", "max_timestamp"):
        if facts[key] != manifest[key]:
            raise SemanticMismatch(f"{path}: {key}")
    if facts["symbols"] != manifest["source"]["vendor_symbols"]:
        raise SemanticMismatch(f"{path}: vendor symbols")
    if semantic_hash_of(records, manifest["record_type"], manifest["contract"]) != manifest["semantic_hash"]:
        raise SemanticMismatch(path)


def verify_location(spark: SparkSession, root: str, storage_root: str, location: str, digest: str) -> str:
    try:
        verify_artifact(spark, files.join(storage_root, location), read_manifest(root, digest))
    except MissingManifest:
        return "missing_manifest"
    except MissingArtifact:
        return "missing_artifact"
    except PhysicalMismatch:
        return "physical_mismatch"
    except (SemanticMismatch, SchemaMismatch):
        return "semantic_mismatch"
    return "ok"


def verify_manifest(spark: SparkSession, root: str, storage_root: str, digest: str) -> str:
    """The best outcome among the manifest's copies."""
    try:
        own = read_manifest(root, digest)
    except MissingManifest:
        return "missing_manifest"
    found = [verify_location(spark, root, storage_root, loc, digest) for loc, h in load_index(root) if h == own["physical_hash"]]
    return min(found, key=OUTCOMES.index, default="missing_artifact")


def outcomes(claims: DataFrame, files: DataFrame) -> DataFrame:
    """For many at once: claims (manifest_hash, location, physical_hash, semantic_hash) against files (location, physical_hash,
    semantic_hash): location and outcome, by a join on the location."""
    met = claims.alias("c").join(files.alias("f"), F.col("c.location") == F.col("f.location"), "left")
    outcome = F.when(F.col("f.location").isNull(), "missing_artifact").when(F.col("c.manifest_hash").isNull(), "missing_manifest").when(F.col("c.physical_hash") != F.col("f.physical_hash"), "physical_mismatch")
    return met.select("c.manifest_hash", "c.location", outcome.when(F.col("c.semantic_hash") != F.col("f.semantic_hash"), "semantic_mismatch").otherwise("ok").alias("outcome"))


def best_outcome(found: DataFrame) -> DataFrame:
    """manifest_hash, outcome: the best among copies."""
    rank = F.array_position(F.array(*[F.lit(o) for o in OUTCOMES]), F.col("outcome"))
    return found.groupBy("manifest_hash").agg(F.min_by("outcome", rank).alias("outcome"))


def locate(manifests_: DataFrame, entries: DataFrame) -> DataFrame:
    """manifest_hash, location of every copy."""
    return manifests_.join(entries, "physical_hash").select("manifest_hash", "location")


def find_by_semantic_hash(manifests_: DataFrame, digest: str) -> DataFrame:
    return manifests_.where(F.col("semantic_hash") == digest).orderBy("manifest_hash")


def rebuild_index(spark: SparkSession, root: str, storage_root: str) -> list[tuple[str, str]]:
    """The index as the files themselves say: those whose bytes some manifest declares."""
    found = physical_hashes(spark, storage_root)
    rows = found.join(manifests(spark, root).select("physical_hash").distinct(), "physical_hash", "left_semi").collect()
    entries = sorted((r.location, r.physical_hash) for r in rows)
    write_index(root, entries)
    return entries


def mapping_findings(symbols: DataFrame, mapping: DataFrame, contract: str | None = None) -> DataFrame:
    """symbol, finding: unmapped (no contract given), divergent (another contract than the dataset's), unused, or mapped."""
    own = symbols.select("symbol").distinct().withColumn("here", F.lit(True))
    met = own.join(mapping.select("symbol", "contract"), "symbol", "full_outer")
    goal = F.lit(contract) if contract is not None else F.col("contract")
    finding = F.when(F.col("contract").isNull(), "unmapped").when(F.col("here").isNull(), "unused").when(F.col("contract") != goal, "divergent").otherwise("mapped")
    return met.select("symbol", finding.alias("finding"))


def migrate(spark: SparkSession, source: str, target: str, mapping: dict[str, str], allow_unused: bool = False) -> str:
    """Rewrites a version 2 artifact as version 3 under the one contract that its symbols map to; the contract is returned."""
    if os.path.realpath(files.at(source)[1]) == os.path.realpath(files.at(target)[1]):
        raise Migration("source and target are the same file")
    for c in mapping.values():
        validate_contract(c)
    found = storage.descriptor(source)
    kind = next((k for k in STORED if _columns_of(source) == [f.name for f in storage.arrow_schema(k, 2)]), None)
    if found.get("schema_version") != "2" or kind is None:
        raise Migration(f"{source} isn't a version 2 artifact")
    records, _ = storage.read_artifact(spark, source, kind=kind)
    given = spark.createDataFrame(list(mapping.items()), "symbol string, contract string")
    findings = {r.symbol: r.finding for r in mapping_findings(records, given).collect()}
    for what in ("unmapped", *(() if allow_unused else ("unused",))):
        if bad := sorted(s for s, f in findings.items() if f == what):
            raise Migration(f"{what} symbols: {', '.join(bad)}")
    contracts = {mapping[s] for s, f in findings.items() if f == "mapped"}
    if len(contracts) != 1:
        raise Migration(f"symbols of one dataset map to {sorted(contracts)}")
    contract = contracts.pop()
    storage.write_artifact(storage.stored_rows(records, kind, contract), target, kind, VERSION, contract)
    return contract


def _columns_of(path: str) -> list[str]:
    return storage._footer(path).names


def validate_contract(text: str) -> str:
    from .rollover import require_listed

    return require_listed(text)


@dataclass(frozen=True)
class Imported:
    path: str
    rows: int
    report: dict[str, Any]


def import_dataset(raw: DataFrame, kind: str, path: str, contract: str | None = None, strict: bool = True, policy: str = "reject") -> Imported:
    """Validates a raw batch and, if it has no errors, writes it in event order, reads it back, compares row by row, and only then lets it
    appear at its path."""
    spark = raw.sparkSession
    raw = raw.persist()
    records, issues = validate.import_batch(raw, kind, VERSION, strict, policy)
    issues = issues.persist()
    total, rows = raw.count(), records.count()
    report = validate.report(issues, total, rows).first().asDict()
    if not report["success"]:
        raise ImportFailed(json.dumps(report | {"codes": [r.code for r in issues.where("severity in ('ERROR', 'FATAL')").select("code").distinct().orderBy("code").collect()]}))
    from .ordering import numbered

    placed = numbered(records.withColumnRenamed("instrument_symbol", "symbol"), "at_us", "source_index", name="ordinal")
    expected = storage.stored_rows(placed, kind, contract).persist()
    staging = f"{path}.{uuid.uuid4().hex}.staging"
    try:
        storage.write_artifact(expected, staging, kind, VERSION if contract else 2, contract)
        back, _ = storage.read_artifact(spark, staging, contract, kind)
        again = storage.stored_rows(back, kind, contract)
        columns = expected.columns
        if expected.exceptAll(again.select(*columns)).take(1) or again.select(*columns).exceptAll(expected).take(1):
            raise ReadBackFailed(path)
        files.move(staging, path)
    finally:
        files.delete(staging)
        expected.unpersist()
        raw.unpersist()
    return Imported(path, rows, report)
