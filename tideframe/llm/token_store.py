"""Content-addressed store of token ids.

Each document's ids are cut where a rolling hash over the last WINDOW ids meets a mask, so equal passages give equal
chunks wherever they stand. A chunk is stored once, under the SHA-256 of its bytes; a document is a recipe, the list of
its chunks' digests. Tables below a store's folder:

* chunks: digest, n, ids (little-endian unsigned numbers of 16 bits, or of 32 where an id needs them)
* recipes: segment, doc_id, start, n_tokens, digests, root; segments hold ascending ranges of doc_id, rows are sorted
* manifest: segment, n_docs, n_tokens, root, and one row (segment null) with the root over the segments

The digest of a chunk is that of its ids in 32 bits. Chunks that only one task made are stored where they were made; a filter of
digests that tasks may share tells the others, and only those shuffle to be stored once.

A document's root is the SHA-256 of its digests in a row, a block's that of BLOCK_DOCS document roots, a segment's that of its
blocks' roots, and the store's that of its segments' roots: a Merkle tree that reading verifies from the chunks up.

Null text counts as empty (only the end id). Rows with the same doc_id are each stored, in the order of their roots; null
doc_ids come first. An empty table gives empty tables. Columns beyond doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import batches_by_bytes, plain, staged, trimmed
from .exact_dedup import repeated_filter
from .tokens import SLICE, encoder, with_end

#: Ids that the rolling hash sees; chunks are MIN_CHUNK to MAX_CHUNK ids long, but for a document's last, and about MEAN_CHUNK.
WINDOW, MIN_CHUNK, MEAN_CHUNK, MAX_CHUNK = 8, 64, 512, 4096
#: Documents of a block in the Merkle tree.
BLOCK_DOCS = 1024
#: Documents of a segment, about.
SEGMENT_DOCS = 50_000


def cut_points(ids: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """For each document, the ends of its chunks, counted from its first id. Ends depend on ids since the chunk's start only."""
    x = (ids.astype(np.uint32) + np.uint32(1)) * np.uint32(0x9E3779B1)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x85EBCA77)
    rolled = x.copy()
    for j in range(1, WINDOW):
        rolled[j:] += x[:-j] << np.uint32(j)
    rolled >>= np.uint32(9)
    rolled %= np.uint32(MEAN_CHUNK - MIN_CHUNK)
    marks = (np.flatnonzero(rolled == 0) + 1).tolist()
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        ends, at = [], a
        while b - at > MIN_CHUNK:
            k = bisect_left(marks, at + MIN_CHUNK)
            end = min(marks[k] if k < len(marks) else b, at + MAX_CHUNK, b)
            ends.append(end - a)
            at = end
        if at < b:
            ends.append(b - a)
        out.append(np.array(ends, np.int64))
    return out


def _chunker(source: bytes, end_id: int, plain_specials: bool):
    def run(batches):
        sent: set[bytes] = set()  # of this task: a chunk's ids leave it once
        for big in batches:
            for batch in batches_by_bytes(big, "text", SLICE):
                ids, bounds = with_end(*encoder(source, plain_specials).encode(batch["text"]), end_id)
                raw = np.ascontiguousarray(ids, "<u4")
                narrow = raw.astype("<u2") if len(raw) and int(raw.max()) < 1 << 16 else raw
                rows = []
                for a, ends in zip(bounds[:-1].tolist(), cut_points(ids, bounds)):
                    digests, lengths, bodies, at = [], [], [], 0
                    for end in ends.tolist():
                        digests.append(d := hashlib.sha256(raw[a + at : a + end]).digest())
                        lengths.append(end - at)
                        bodies.append(None if d in sent else narrow[a + at : a + end].tobytes())
                        sent.add(d)
                        at = end
                    rows.append((digests, lengths, bodies))
                    if len(sent) > 100_000:
                        sent.clear()
                yield pa.record_batch(
                    [
                        batch["doc_id"],
                        pa.array(np.diff(bounds), pa.int64()),
                        pa.array([r[0] for r in rows], pa.list_(pa.binary())),
                        pa.array([r[1] for r in rows], pa.list_(pa.int32())),
                        pa.array([r[2] for r in rows], pa.list_(pa.binary())),
                        pa.array([hashlib.sha256(b"".join(r[0])).digest() for r in rows], pa.binary()),
                    ],
                    names=["doc_id", "n_tokens", "digests", "lengths", "bodies", "root"],
                )
        trimmed()

    return run


@dataclass(frozen=True)
class TokenStore:
    """A written store's tables."""

    path: str

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        return spark.read.parquet(f"{self.path}/{name}")


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int, plain_specials: bool = False) -> TokenStore:
    """Encodes docs (doc_id, text), each followed by end_id, and writes the store below path. tokenizer: a file on the driver,
    whose bytes go to the tasks; plain_specials: see tokens."""
    spark = docs.sparkSession
    source = Path(tokenizer).read_bytes()
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_tokens bigint, digests array<binary>, lengths array<int>, bodies array<binary>, root binary"
    cut = staged(plain(docs, "doc_id", "text").mapInArrow(_chunker(source, end_id, plain_specials), schema), "token-chunks")

    listed = cut.select(F.explode(F.arrays_zip("digests", "lengths", "bodies")).alias("c")).where("c.bodies is not null")
    chunks = listed.select(F.col("c.digests").alias("digest"), F.col("c.lengths").alias("n"), F.col("c.bodies").alias("ids"))
    # Which digests tasks may share is found from hashes alone; only chunks that a filter of those holds shuffle with their ids.
    keys = cut.select(F.explode(F.arrays_zip("digests", "bodies")).alias("c")).where("c.bodies is not null").select(F.xxhash64("c.digests").alias("h"))
    keys = staged(keys, "chunk-keys")
    bloom, plane = repeated_filter(keys, "chunk-flags")
    sent = spark.sparkContext.broadcast(plane)

    def flag(batches):
        for batch in batches:
            found = bloom.has(sent.value, batch["h"].to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], names=[*batch.schema.names, "maybe"])
        trimmed()

    flagged = chunks.withColumn("h", F.xxhash64("digest")).mapInArrow(flag, "digest binary, n int, ids binary, h bigint, maybe boolean")
    alone, met = (flagged.where(c).select("digest", "n", "ids") for c in ("not maybe", "maybe"))
    alone.unionByName(met.dropDuplicates(["digest"])).write.option("compression", "zstd").parquet(f"{path}/chunks")

    n = cut.count()
    segments = max(1, -(-n // SEGMENT_DOCS))
    by = [F.col("doc_id").asc_nulls_first(), F.col("root")]
    ranged = cut.select("doc_id", "n_tokens", "digests", "root").repartitionByRange(segments, *by).sortWithinPartitions(*by)
    ranged = staged(ranged.withColumn("segment", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()), "token-ranges")
    sums = ranged.groupBy("segment").agg(F.sum("n_tokens").alias("n")).orderBy("segment").collect()  # a row for each segment
    before, total = {}, 0
    for r in sums:
        before[r.segment], total = total, total + r.n
    offsets = spark.createDataFrame(list(before.items()), "segment int, before bigint")
    w = Window.partitionBy("segment").orderBy("at")
    recipes = (
        ranged.join(F.broadcast(offsets), "segment")
        .withColumn("start", F.col("before") + F.sum("n_tokens").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_tokens"))
        .withColumn("block", F.floor((F.row_number().over(w) - 1) / BLOCK_DOCS))
        .select("segment", "block", "doc_id", "start", "n_tokens", "digests", "root", "at")
    )
    recipes.repartition(segments, "segment").sortWithinPartitions("segment", "at").write.option("compression", "zstd").parquet(f"{path}/recipes")

    written = TokenStore(path)
    roots = merkle_roots(written.table(spark, "recipes"))
    top = F.unhex(F.sha2(F.concat(F.lit(b""), F.expr("aggregate(transform(array_sort(collect_list(struct(segment, root))), x -> x.root), X'', (a, x) -> concat(a, x))")), 256))
    every = roots.agg(F.lit(None).cast("int").alias("segment"), F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n_docs"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n_tokens"), top.alias("root"))
    roots.unionByName(every).coalesce(1).write.parquet(f"{path}/manifest")
    return written


def _row_of(column: str, order: str) -> str:
    return f"unhex(sha2(aggregate(transform(array_sort(collect_list(struct({order}, {column}))), x -> x.{column}), X'', (a, x) -> concat(a, x)), 256))"


def merkle_roots(recipes: DataFrame) -> DataFrame:
    """segment, n_docs, n_tokens, root, from the documents' digests upwards; groups are of BLOCK_DOCS documents, then of one segment's blocks."""
    own = F.expr("unhex(sha2(aggregate(digests, X'', (a, x) -> concat(a, x)), 256))")
    docs = recipes.select("segment", "block", "at", "n_tokens", own.alias("root"))
    blocks = docs.groupBy("segment", "block").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.expr(_row_of("root", "at")).alias("root"))
    return blocks.groupBy("segment").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.expr(_row_of("root", "block")).alias("root"))


def _crc_tables() -> np.ndarray:
    """Tables [k, byte place, byte value] that move a CRC-32 over 2**k zero bytes."""
    def spread(bits: np.ndarray) -> np.ndarray:
        t = np.zeros((4, 256), np.uint32)
        for place in range(4):
            for i in range(8):
                t[place, np.arange(256) >> i & 1 == 1] ^= bits[8 * place + i]
        return t

    def moved(t: np.ndarray, x: np.ndarray) -> np.ndarray:
        return t[0, x & 255] ^ t[1, x >> 8 & 255] ^ t[2, x >> 16 & 255] ^ t[3, x >> 24]

    tables = [spread(_linear_step())]
    for _ in range(39):
        bits = moved(tables[-1], moved(tables[-1], np.uint32(1) << np.arange(32, dtype=np.uint32)))
        tables.append(spread(bits))
    return np.stack(tables)


def _linear_step() -> np.ndarray:
    """What one zero byte makes of each single bit of a CRC-32 register without its inversions."""
    out = np.uint32(1) << np.arange(32, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, (out >> 1) ^ np.uint32(0xEDB88320), out >> 1).astype(np.uint32)
    return out


def shift_crc(crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """Of each CRC-32, its share in the CRC-32 of a text with n_bytes more behind it; shares of a text's parts XOR to its CRC-32."""
    global _tables
    if _tables is None:
        _tables = _crc_tables()
    x, left, k = crc.astype(np.uint32), n_bytes.astype(np.int64).copy(), 0
    while (left > 0).any():
        on = (left & 1) == 1
        t, y = _tables[k], x[on]
        x[on] = t[0, y & 255] ^ t[1, y >> 8 & 255] ^ t[2, y >> 16 & 255] ^ t[3, y >> 24]
        left >>= 1
        k += 1
    return x


_tables: np.ndarray | None = None


def unpacked(body: bytes, n: int) -> np.ndarray:
    """A stored chunk's n ids as little-endian unsigned 32-bit numbers."""
    if len(body) not in (2 * n, 4 * n):
        raise ValueError("a chunk's length isn't that of its ids")
    return np.frombuffer(body, "<u2" if len(body) == 2 * n else "<u4").astype("<u4")


def _verified(batches):
    for batch in batches:
        crc, n = [], []
        for digest, count, body in zip(batch["digest"].to_pylist(), batch["n"].to_pylist(), batch["ids"].to_pylist()):
            ids = unpacked(body, count)
            if hashlib.sha256(ids).digest() != digest:
                raise ValueError(f"chunk {digest.hex()} doesn't hold what its name says")
            crc.append(zlib.crc32(ids))
            n.append(count)
        yield pa.record_batch([batch["digest"], pa.array(n, pa.int32()), pa.array(crc, pa.int64())], names=["digest", "n", "crc"])


def read_digests(spark: SparkSession, store: TokenStore) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, n_chunks, all from the files.

    Each stored chunk is read once and held against its digest; a document's CRC-32 is put together from its chunks',
    so no chunk's ids are moved to the documents that use it. Fails where a chunk is damaged or missing, a document's length is
    not that of its chunks, or a Merkle root differs.
    """
    checked = store.table(spark, "chunks").mapInArrow(_verified, "digest binary, n int, crc bigint")
    recipes = store.table(spark, "recipes")
    spots = recipes.select("segment", "at", F.posexplode("digests").alias("seq", "digest"))
    sized = spots.join(checked, "digest", "left").withColumn("n", F.coalesce("n", F.raise_error(F.concat(F.lit("no chunk "), F.hex("digest"))).cast("int")))
    lengths = sized.groupBy("segment", "at").agg(F.array_sort(F.collect_list(F.struct("seq", "n", "crc"))).alias("c"))
    shares = lengths.mapInArrow(_folded, "segment int, at bigint, read_tokens bigint, ids_crc32 bigint, n_chunks int")
    found = recipes.select("segment", "at", "doc_id", "start", "n_tokens").join(shares, ["segment", "at"], "left")
    same = F.coalesce(F.col("read_tokens"), F.lit(0)) == F.col("n_tokens")
    stated = store.table(spark, "manifest").where("segment is not null").select("segment", F.col("root").alias("stated"))
    wrong = merkle_roots(recipes).join(stated, "segment", "left").where("not (root <=> stated)")
    if wrong.take(1):
        raise ValueError("a segment's Merkle root differs from the manifest's")
    return found.select(
        "doc_id",
        "start",
        F.when(same, F.col("n_tokens")).otherwise(F.raise_error(F.lit("a document's length differs from its chunks'")).cast("bigint")).alias("n_tokens"),
        F.coalesce("ids_crc32", F.lit(0)).cast("bigint").alias("ids_crc32"),
        F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"),
    )


def _folded(batches):
    for batch in batches:
        lists = batch["c"]
        flat, offsets = lists.flatten(), lists.offsets.to_numpy()
        offsets = offsets - offsets[0]
        n = flat.field("n").to_numpy().astype(np.int64)
        crc = flat.field("crc").to_numpy()
        run = np.concatenate([[0], np.cumsum(n)])
        last = np.repeat(run[offsets[1:]], np.diff(offsets))
        share = shift_crc(crc, 4 * (last - run[1:])).astype(np.uint32)
        crcs = np.bitwise_xor.reduceat(share, offsets[:-1]).astype(np.int64) if len(share) else np.zeros(0, np.int64)
        totals, counts = run[offsets[1:]] - run[offsets[:-1]], np.diff(offsets)
        yield pa.record_batch(
            [batch["segment"], batch["at"], pa.array(totals, pa.int64()), pa.array(crcs, pa.int64()), pa.array(counts, pa.int32())],
            names=["segment", "at", "read_tokens", "ids_crc32", "n_chunks"],
        )


def read_documents(spark: SparkSession, store: TokenStore) -> DataFrame:
    """doc_id, start, ids (array of int): whole documents put together again from their chunks."""
    recipes = store.table(spark, "recipes")
    spots = recipes.select("segment", "at", F.posexplode("digests").alias("seq", "digest"))
    bodies = spots.join(store.table(spark, "chunks"), "digest")
    whole = bodies.groupBy("segment", "at").agg(F.array_sort(F.collect_list(F.struct("seq", "n", "ids"))).alias("c"))

    def unpack(batches):
        for batch in batches:
            ids = [np.concatenate([unpacked(x["ids"], x["n"]) for x in c]).astype(np.int32) for c in batch["c"].to_pylist()]
            yield pa.record_batch([batch["doc_id"], batch["start"], pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "start", "ids"])

    kind = dict(recipes.dtypes)["doc_id"]
    return recipes.select("segment", "at", "doc_id", "start").join(whole, ["segment", "at"]).select("doc_id", "start", "c").mapInArrow(unpack, f"doc_id {kind}, start bigint, ids array<int>")
