"""Best-fit packing by sums of squares.

An item goes where the sum of the squared numbers of open bins per residual gap becomes smallest: among the bins with room for it, into one
of the gap h that minimises N(h - s) - N(h); a new bin is opened where none has room. Items are packed in blocks of about
BLOCK_ITEMS, dealt by a hash of the document, largest first, so that the small ones fill what is left. Then the bins that a block filled
worst are dissolved and their items packed again together, where that takes fewer bins. Only lengths, never ids, are moved.

Null text is empty: one piece of one id. Repeated rows are packed each; ties are settled by the order of the pieces' keys, so reruns over the same
stored pieces agree. An empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_by_bytes, plain, staged, trimmed
from .tokens import SLICE, encoder, with_end

#: Items of a block, about: one task packs a block; and the share of a bin below which it is dissolved.
BLOCK_ITEMS, DISSOLVED = 5_000, 0.97


def sum_of_squares(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For items in the given order (sizes 0 to capacity): each one's bin, numbered from 0, and its place in it."""
    counts = np.zeros(capacity + 1, np.int64)  # open bins by gap
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, places, made = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), 0
    for i, s in enumerate(sizes.tolist()):
        # The change of the sum of squares, halved and less its constant: gap h turns into h - s; full bins don't count.
        fits = counts[s:]
        gain = counts[: capacity + 1 - s] - fits
        if s < capacity:
            gain[0] = -fits[0]
        gain = np.where(fits > 0, gain, np.iinfo(np.int64).max)
        best = int(np.argmin(2 * np.minimum(gain, 1 << 40) - (np.arange(len(gain)) == 0))) + s  # a filled bin leaves the sum: half a step more
        if counts[best] > 0:
            b = stacks[best].pop()
            counts[best] -= 1
            gap = best
        else:
            b, gap = made, capacity
            made += 1
        bins[i], places[i] = b, capacity - gap
        if gap > s:
            stacks[gap - s].append(b)
            counts[gap - s] += 1
    return bins, places


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 1024, plain_specials: bool = False) -> DataFrame:
    """doc_id, copy, piece, start, length, ids_crc32 of each document's ids with end_id behind them.

    A document of more than capacity ids is cut into pieces of that length, the first of which may be shorter. Null text
    is empty: one piece of one id. Rows that repeat a doc_id are told apart by copy, any number that differs.
    """
    kind = dict(docs.dtypes)["doc_id"]

    source = Path(tokenizer).read_bytes()

    def run(batches):
        for big in batches:
            for batch in batches_by_bytes(big, "text", SLICE):
                ids, bounds = with_end(*encoder(source, plain_specials).encode(batch["text"]), end_id)
                raw = memoryview(ids.astype("<u4").tobytes())
                total = np.diff(bounds)
                count = -(-total // capacity)
                doc = np.repeat(np.arange(len(total)), count)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
                first = total - (count - 1) * capacity
                start = np.where(piece == 0, 0, first[doc] + (piece - 1) * capacity)
                length = np.where(piece == 0, first[doc], capacity)
                begin = bounds[:-1][doc] + start
                crc = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(begin.tolist(), length.tolist())]
                at = pa.array(doc)
                yield pa.record_batch(
                    [batch["doc_id"].take(at), batch["copy"].take(at), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    names=["doc_id", "copy", "piece", "start", "length", "ids_crc32"],
                )
        trimmed()

    own = plain(docs, "doc_id", "text").withColumn("copy", F.monotonically_increasing_id())
    return own.mapInArrow(run, f"doc_id {kind}, copy bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


def _packed(items: DataFrame, capacity: int, n: int) -> DataFrame:
    """items (key, size) with block, bin and place."""
    blocks = max(1, -(-n // BLOCK_ITEMS))
    dealt = items.withColumn("block", F.pmod(F.xxhash64("key", F.lit(7)), F.lit(blocks)).cast("int"))

    def run(table: pa.Table) -> pa.Table:
        key, size = table["key"].combine_chunks(), table["size"].to_numpy()
        order = np.lexsort((key.to_numpy(), -size))
        bins, places = sum_of_squares(size[order], capacity)
        at = pa.array(order)
        return pa.table({"key": key.take(at), "size": pa.array(size[order]), "block": table["block"].combine_chunks().take(at), "bin": pa.array(bins), "place": pa.array(places)})

    return dealt.groupBy("block").applyInArrow(run, "key bigint, size bigint, block int, bin bigint, place bigint")


def pack(items: DataFrame, capacity: int) -> DataFrame:
    """items (key bigint, unique; size bigint, 0 to capacity): key, sequence_id, offset.

    Within a sequence, offsets run from 0 without gaps. Reruns over the same items agree. Empty input gives no rows.
    """
    first = staged(_packed(items, capacity, items.count()), "packed").withColumn("own", F.col("block").cast("bigint") * (1 << 32) + F.col("bin"))
    worst = staged(first.groupBy("own").agg(F.sum("size").alias("filled")).where(F.col("filled") < DISSOLVED * capacity).select("own"), "dissolved")
    met = first.join(worst.withColumn("worst", F.lit(True)), "own", "left")
    again = staged(met.where("worst").select("key", "size"), "left-items")
    packed = staged(_packed(again, capacity, again.count()), "packed-again")
    # Full sequences keep even numbers, those of the second round get odd ones.
    plainly = lambda df: df.select("key", (F.col("own") * 2).alias("sequence_id"), F.col("place").alias("offset"))
    if packed.select("block", "bin").distinct().count() >= worst.count():
        return plainly(first)
    second = packed.select("key", ((F.col("block").cast("bigint") * (1 << 32) + F.col("bin")) * 2 + 1).alias("sequence_id"), F.col("place").alias("offset"))
    return plainly(met.where("worst is null")).unionByName(second)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 1024) -> DataFrame:
    """Each piece of each document with its sequence_id and offset; see pieces() and pack()."""
    cut = staged(pieces(docs, tokenizer, end_id, capacity), "pieces").withColumn("key", F.monotonically_increasing_id())
    cut = staged(cut, "keyed-pieces")
    placed = pack(cut.select("key", F.col("length").alias("size")), capacity)
    return cut.join(placed, "key").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "copy")
