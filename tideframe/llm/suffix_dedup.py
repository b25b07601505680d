"""Repeated passages by a logarithmic family of sparse suffix arrays.

A passage is a string of LENGTH bytes that starts at two places of the corpus or more; all bytes that passages cover go.

Every window of LENGTH bytes has an anchor, the leftmost of its K-byte strings with the smallest hash. Windows in a row with one
anchor form a run, and equal windows have equal anchors at equal places, so matches are only sought among suffixes that begin
at anchors with the same string. A suffix array holds one entry for each run, about one for 85 bytes, in the order of its
suffix: the anchor's K bytes by their hash, then the text behind it, STEPS blocks of STEP bytes renamed to 16 bits each. An
entry also has the blocks before its anchor, nearest first, the run's hash, how often the run occurs and one of its places.

New batches of documents get suffix arrays of their own. An index is a family of levels whose sizes grow geometrically: a new
array is merged with the level of its size, and the result moves up while there is a level of its size; it is then scanned
together with each level that is left. Merging and scanning read both arrays in their common order, one anchor after the other. A run
that stands in it twice is a match from end to end; these are most. Two other entries can only match where the blocks that they share
behind the anchor (their common prefix in the order) and before it leave room for LENGTH equal bytes, three blocks at least;
where that is so and one of them occurs once, both are open. Of open entries one place each is read again, and the
bytes of those under one anchor are compared window by window. Groups of more than GROUP_RUNS of them, which
one task shouldn't hold, are compared by a shuffle of their windows' hashes instead; anchors of more than HELD entries are all open.

Null text is empty; matches never cross documents; a row that repeats another's doc_id and text matches it. Rows are told
apart by doc_id and text, so doc_ids may repeat or be null. An empty table gives no rows; other columns are ignored, whatever their
names. Hashes have 128 bits where equality decides; 64 or fewer only group, and can make more be compared, never less.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Bloom, batches_by_bytes, build_bloom, plain, staged, trimmed, unstage

LENGTH, K = 200, 32
#: Blocks of an entry's context on each side, and their bytes.
STEPS, STEP = 4, 40
#: Blocks that two entries share at least where they match: the rest of LENGTH is the anchor and a part of a block on each side.
SHARED = -(-(LENGTH - K - 2 * (STEP - 1)) // STEP)
#: Batches that a table given at once is dealt to. Every batch is scanned against all before it, so the number is the same at any size.
BATCHES = 3
GROUP_RUNS = 16_384
#: Entries of one anchor that a task holds, and entries that it counts before they are sent.
HELD, COUNTED = 400_000, 100_000
#: Bytes of runs that one task compares at a time, whole groups.
TOGETHER = 1_000_000
#: Bytes of texts whose hashes a task holds at a time.
SLICE = 500_000
_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xC2B2AE3D27D4EB4F)


_BYTES = np.random.default_rng(19).integers(0, 1 << 63, (3, 256), dtype=np.uint64) | np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hashes of strings put together; the shift keeps sums of unlike parts from cancelling."""
    out = right >> np.uint64(31)
    out ^= right
    out += left * _Q
    return out


def grams(raw: np.ndarray) -> np.ndarray:
    """Hashes of all K-byte strings of raw, by doubling."""
    h, n = _BYTES[0][raw], 1
    while n < K:
        h = _joined(h[: len(h) - n], h[n:]) if len(h) > n else h[:0]
        n *= 2
    return _mix(h)


def runs(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of texts that stand in a row and end at `ends`: for each run its text, first and last window, anchor and the anchor's hash."""
    wide = LENGTH - K + 1
    if len(raw) < LENGTH:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none.astype(np.uint64)
    hashed = grams(raw)
    # Hash above, place below: of equal hashes the leftmost place is the smallest number.
    n = len(hashed)
    blocks = -(-n // wide)
    ranked = np.full(blocks * wide, np.iinfo(np.uint64).max, np.uint64)
    ranked[:n] = (hashed & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
    grid = ranked.reshape(blocks, wide)
    # A window's minimum is that of the rest of the block where it begins and the first part of the next one.
    first = np.minimum.accumulate(grid, axis=1).ravel()
    rest = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = n - wide + 1
    anchor = (np.minimum(rest[:windows], first[wide - 1 : wide - 1 + windows]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    text = np.repeat(np.arange(len(ends)), np.diff(np.concatenate([[0], ends])))[:windows]
    valid = np.arange(windows) + LENGTH <= ends[text]
    change = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]) | (valid[1:] != valid[:-1])]))
    last = np.append(change[1:], windows) - 1
    keep = valid[change]
    change, last = change[keep], last[keep]
    return text[change], change, last, anchor[change], hashed[anchor[change]]


def window_hashes(raw: np.ndarray, seed: int) -> np.ndarray:
    """Hashes of all strings of LENGTH bytes, put together from strings of 128, 64 and 8 bytes."""
    h, n, out, need, at = _BYTES[seed][raw], 1, None, LENGTH, 0
    count = len(raw) - LENGTH + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    while need:
        if need & n:
            part = h[at : at + count]
            out = part.copy() if out is None else _joined(out, part)
            at += n
            need -= n
        if need:
            h = _joined(h[: len(h) - n], h[n:])
            n *= 2
    return _mix(out)


def _texts(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a batch's texts in a row, and where each ends."""
    t = pc.fill_null(batch["text"], "").cast(pa.large_binary())
    bounds = np.frombuffer(t.buffers()[1], np.int64)[t.offset : t.offset + len(t) + 1]
    raw = np.frombuffer(t.buffers()[2], np.uint8)[bounds[0] : bounds[-1]] if t.buffers()[2] else np.zeros(0, np.uint8)
    return raw, bounds[1:] - bounds[0]


def contexts(raw: np.ndarray, ends: np.ndarray, text: np.ndarray, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The blocks behind and before each anchor, nearest first from the highest bits down; 0 for blocks that a text doesn't hold."""
    eight = np.ndarray(max(0, len(raw) - 7), np.dtype("<u8"), np.ascontiguousarray(raw), strides=(1,))
    begin = np.concatenate([[0], ends[:-1]])[text] if len(text) else anchor
    end = ends[text] if len(text) else anchor
    out = []
    for first, step in ((anchor + K, STEP), (anchor - STEP, -STEP)):
        packed = np.zeros(len(anchor), np.uint64)
        for k in range(STEPS):
            at = first + k * step
            inside = np.flatnonzero((at >= begin) & (at + STEP <= end))
            h = np.full(len(inside), _Q)
            for w in range(0, STEP, 8):
                h = _mix(h * _P + eight[at[inside] + w])
            block = np.zeros(len(anchor), np.uint64)
            block[inside] = (h >> np.uint64(48)) | np.uint64(1)
            packed = packed << np.uint64(16) | block
        out.append(packed)
    return out[0], out[1]


def _entries(batches):
    for big in batches:
        for batch in batches_by_bytes(big, "text", SLICE):
            raw, ends = _texts(batch)
            text, lo, hi, anchor, key = runs(raw, ends)
            right, left = contexts(raw, ends, text, anchor)
            begin = np.concatenate([[0], ends[:-1]])[text] if len(text) else lo
            view = memoryview(raw)
            prints = b"".join([hashlib.blake2b(view[a : b + LENGTH], digest_size=16).digest() for a, b in zip(lo.tolist(), hi.tolist())])
            run = np.frombuffer(prints, np.int64).reshape(-1, 2)
            at = pa.array(text)
            rows = batch["row"].to_numpy()[text]
            columns = [pa.array(x.view(np.int64)) for x in (key, right, left)] + [pa.array(run[:, 0].copy()), pa.array(run[:, 1].copy()), batch["doc_id"].take(at), pa.array(rows)]
            columns += [pa.array((lo - begin).astype(np.int32)), pa.array((hi - begin).astype(np.int32)), pa.array(_spot(rows, lo - begin))]
            yield pa.record_batch(columns, names=[*ORDER, "doc_id", "row", "lo", "hi", "spot"])
    trimmed()


def _spot(row: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """A place as one 64-bit key of a filter."""
    return _mix(row.astype(np.int64).view(np.uint64) * _P + lo.astype(np.uint64)).view(np.int64)


#: An entry's place in the order.
ORDER = ["anchor", "right", "left", "run1", "run2"]
ENTRY = "anchor bigint, right bigint, left bigint, run1 bigint, run2 bigint, n bigint, spot bigint"


def _counted(batches):
    """Entries, each once for some hundred thousand of a task, so that what repeats without end is counted before it moves."""
    held: list[pa.RecordBatch] = []

    def put():
        out = pa.Table.from_batches(held).group_by(ORDER, use_threads=False).aggregate([("n", "sum"), ("spot", "min")])
        held.clear()
        return out.select([*ORDER, "n_sum", "spot_min"]).rename_columns([*ORDER, "n", "spot"]).combine_chunks().to_batches()

    for batch in batches:
        held.append(batch)
        if sum(x.num_rows for x in held) >= COUNTED:
            yield from put()
    if held:
        yield from put()
    trimmed()


def _merged(table: pa.Table, all_open: bool) -> pa.RecordBatch:
    """Entries in order, of whole anchors: equal runs as one, and which entries are open."""
    columns = {c: table[c].to_numpy() for c in [*ORDER, "n", "spot"]}
    change = np.concatenate([[True], np.any([columns[c][1:] != columns[c][:-1] for c in ORDER], axis=0)])
    first = np.flatnonzero(change)
    n, spot = np.add.reduceat(columns["n"], first), np.minimum.reduceat(columns["spot"], first)
    anchor, right, left = (columns[c][first].view(np.uint64) for c in ORDER[:3])
    open_ = np.full(len(first), all_open)
    if not all_open:
        # Anchors of one entry, or of none that occurs once, are settled.
        edge = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        size = np.diff(np.append(edge, len(first)))
        some = (size > 1) & np.logical_or.reduceat(n == 1, edge)
        at = np.flatnonzero(np.repeat(some, size))
        for behind in range(SHARED + 1):
            # Entries that share the anchor, `behind` blocks behind it and the others before it.
            key = _mix(anchor[at] + _P)
            for side, blocks in ((right, behind), (left, SHARED - behind)):
                key = _mix(key * _P + (side[at] >> np.uint64(16 * (STEPS - blocks)) if blocks else np.uint64(0)))
            _, group, count = np.unique(key, return_inverse=True, return_counts=True)
            single = np.bincount(group, n[at] == 1, len(count)) > 0
            open_[at] |= ((count > 1) & single)[group]
    return pa.record_batch([*[pa.array(columns[c][first]) for c in ORDER], pa.array(n), pa.array(spot), pa.array(open_)], names=[*ORDER, "n", "spot", "open"])


def _scan(batches):
    """Over entries in order: the merged entries, each with `open`."""
    held: list[pa.RecordBatch] = []
    going = False  # whether entries of the held anchor were already given out

    for batch in batches:
        if not batch.num_rows:
            continue
        batch = batch.select([*ORDER, "n", "spot"])
        anchors = batch["anchor"].to_numpy()
        if held and held[-1]["anchor"][-1].as_py() != anchors[0]:
            yield _merged(pa.Table.from_batches(held), going)
            held, going = [], False
        edge = np.flatnonzero(anchors[1:] != anchors[:-1]) + 1
        if len(edge):
            if going:  # the rest of an anchor that is all open, then whole ones
                yield _merged(pa.Table.from_batches([*held, batch.slice(0, int(edge[0]))]), True)
                held, batch, edge = [], batch.slice(int(edge[0])), edge - edge[0]
            if int(edge[-1]) or held:
                yield _merged(pa.Table.from_batches([*held, batch.slice(0, int(edge[-1]))]), False)
            held, going = [], False
            batch = batch.slice(int(edge[-1]))
        held.append(batch)
        if sum(x.num_rows for x in held) > HELD:
            yield _merged(pa.Table.from_batches(held), True)
            held, going = [], True
    if held:
        yield _merged(pa.Table.from_batches(held), going)
    trimmed()


class IndexFamily:
    """Levels of suffix arrays; level i holds the arrays of 2**i batches. Each array is stored in order, with what its scan found."""

    def __init__(self) -> None:
        self.levels: list[DataFrame | None] = []
        self.between: list[DataFrame] = []

    @staticmethod
    def scan(*arrays: DataFrame) -> DataFrame:
        every = arrays[0].select(*ORDER, "n", "spot")
        for x in arrays[1:]:
            every = every.unionByName(x.select(*ORDER, "n", "spot"))
        # Shards by the anchor's hash, each in order.
        return every.repartition("anchor").sortWithinPartitions(*ORDER).mapInArrow(_scan, f"{ENTRY}, open boolean")

    def add(self, occurrences: DataFrame) -> None:
        """A batch: its array merges with levels of its size, and is scanned against the others."""
        array = occurrences.select(*ORDER, F.lit(1).cast("bigint").alias("n"), "spot").mapInArrow(_counted, ENTRY)
        i = 0
        while i < len(self.levels) and self.levels[i] is not None:
            below, level = array, self.levels[i]
            array, self.levels[i] = staged(self.scan(below, level), f"level-{i + 1}"), None
            unstage(below, level)
            i += 1
        if i == 0:
            array = staged(self.scan(array), "level-0")
        self.levels.extend([None] * (i + 1 - len(self.levels)))
        self.levels[i] = array
        for level in self.levels[i + 1 :]:
            if level is not None:
                self.between.append(staged(self.scan(array, level).where("n > 1 or open"), "between-levels"))

    def found(self) -> DataFrame:
        """Entries that are repeated (n > 1) or open, of all scans; an entry may come more than once."""
        held = [x.where("n > 1 or open") for x in [*self.levels, *self.between] if x is not None]
        out = held[0]
        for x in held[1:]:
            out = out.unionByName(x)
        return out


def _where(df: DataFrame, column: str, bloom: Bloom, plane: np.ndarray, *columns: str) -> DataFrame:
    """Rows of df whose 64-bit column the filter may hold."""
    sent = df.sparkSession.sparkContext.broadcast(plane)  # of at most 32 MB

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(bloom.has(sent.value, batch[column].to_numpy())))

    own = df.select(*columns)
    return own.mapInArrow(run, own.schema)


def _compare(batches):
    """Over runs (anchor, doc_id, row, lo, raw) sorted by anchor: doc_id, row, start, end of stretches of windows that occur twice among them."""
    held: list[pa.RecordBatch] = []
    size = 0

    def emit():
        table = pa.Table.from_batches(held).combine_chunks()
        spans = table["raw"].to_pylist()
        raw = np.frombuffer(b"".join(spans), np.uint8)
        lengths = np.array([len(x) for x in spans])
        ends = np.cumsum(lengths)
        owner = np.repeat(np.arange(len(spans)), lengths)[: max(0, len(raw) - LENGTH + 1)]
        inside = np.flatnonzero(np.arange(len(owner)) + LENGTH <= ends[owner])
        one, two = window_hashes(raw, 1)[inside], window_hashes(raw, 2)[inside]
        order = np.lexsort((two, one))
        same = (one[order][1:] == one[order][:-1]) & (two[order][1:] == two[order][:-1])
        again = np.zeros(len(order), bool)
        again[1:] |= same
        again[:-1] |= same
        places = np.sort(inside[order[again]])
        if not len(places):
            return None
        cut = np.concatenate([[True], (np.diff(places) > 1) | (np.diff(owner[places]) > 0)])
        first, last = places[cut], places[np.append(np.flatnonzero(cut)[1:], len(places)) - 1]
        o = owner[first]
        base = table["lo"].to_numpy()[o] - (ends - lengths)[o]
        at = pa.array(o)
        return pa.record_batch(
            [table["doc_id"].combine_chunks().take(at), table["row"].combine_chunks().take(at), pa.array((first + base).astype(np.int32)), pa.array((last + base + LENGTH).astype(np.int32))],
            names=["doc_id", "row", "start", "end"],
        )

    for big in batches:
        for batch in batches_by_bytes(big, "raw", 1_000_000):
            anchors = batch["anchor"].to_numpy()
            at = 0
            if held and size >= TOGETHER:  # the group that stands last ends where another anchor begins
                same = np.flatnonzero(anchors != held[-1]["anchor"][-1].as_py())
                at = int(same[0]) if len(same) else len(anchors)
                if at:
                    held.append(batch.slice(0, at))
                if at < len(anchors):
                    if (out := emit()) is not None:
                        yield out
                    held, size = [], 0
            if at < len(anchors):
                held.append(batch.slice(at))
                size += pc.sum(pc.binary_length(batch["raw"].slice(at))).as_py() or 0
    if held and (out := emit()) is not None:
        yield out


def _windows(batches):
    for big in batches:
        for batch in batches_by_bytes(big, "raw", 1_000_000):
            for i, x in enumerate(batch["raw"].to_pylist()):
                raw = np.frombuffer(x, np.uint8)
                one, two = window_hashes(raw, 1).view(np.int64), window_hashes(raw, 2).view(np.int64)
                at = pa.array(np.full(len(one), i))
                yield pa.record_batch([pa.array(one), pa.array(two), batch["doc_id"].take(at), batch["row"].take(at), pa.array((batch["lo"][i].as_py() + np.arange(len(one))).astype(np.int32))], names=["one", "two", "doc_id", "row", "start"])


def repeated_stretches(docs: DataFrame, batches: int = BATCHES, group_runs: int = GROUP_RUNS) -> DataFrame:
    """docs (doc_id, row, text): doc_id, row, start, end of stretches, which may overlap, whose windows all occur twice or more."""
    spark = docs.sparkSession
    kind = dict(docs.dtypes)["doc_id"]
    occurrences = staged(docs.mapInArrow(_entries, f"anchor bigint, right bigint, left bigint, run1 bigint, run2 bigint, doc_id {kind}, row bigint, lo int, hi int, spot bigint"), "suffixes")
    family = IndexFamily()
    for i in range(batches):
        family.add(occurrences.where(F.pmod("row", F.lit(batches)) == i))
    entries = staged(family.found(), "found-entries")
    unstage(*family.levels, *family.between)
    # Runs that occur twice: a filter lets few other occurrences through to the join.
    twice = staged(entries.where("n > 1").select("run1", "run2", "anchor").distinct(), "repeated-runs")
    bloom = Bloom.sized(twice.count(), 16)
    full = _where(occurrences, "run1", bloom, build_bloom(twice.select("run1"), bloom), "run1", "run2", "anchor", "doc_id", "row", "lo", "hi").join(twice, ["run1", "run2", "anchor"], "left_semi")
    found = full.select("doc_id", "row", F.col("lo").alias("start"), (F.col("hi") + LENGTH).alias("end"))

    # One place of each open entry. What the filters let through besides is compared too, and finds nothing that isn't there.
    places = staged(entries.where("open").select("anchor", "spot").distinct(), "open-places")
    open_ = places.groupBy("anchor").agg(F.count(F.lit(1)).alias("m"))
    bloom = Bloom.sized(places.count(), 24)
    plane = build_bloom(places.select("spot"), bloom)
    sent = spark.sparkContext.broadcast(plane)
    rows = _where(occurrences, "spot", bloom, plane, "spot", "row").select("row").distinct()
    rows = staged(rows, "open-rows")
    bloom_rows = Bloom.sized(rows.count(), 16)
    sent_rows = spark.sparkContext.broadcast(build_bloom(rows, bloom_rows))
    many = open_.where(F.col("m") > group_runs).select("anchor")
    n_many = many.count()
    large = Bloom.sized(n_many, 24)
    sent_large = spark.sparkContext.broadcast(build_bloom(many, large) if n_many else np.zeros(large.bits // 8, np.uint8))

    def spans(batches):
        for big in batches:
            big = big.filter(pa.array(bloom_rows.has(sent_rows.value, big["row"].to_numpy())))
            for batch in batches_by_bytes(big, "text", SLICE):
                raw, ends = _texts(batch)
                text, lo, hi, _, key = runs(raw, ends)
                if not len(text):
                    continue
                begin = np.concatenate([[0], ends[:-1]])[text]
                rows = batch["row"].to_numpy()[text]
                keep = np.flatnonzero(bloom.has(sent.value, _spot(rows, lo - begin)))
                view = memoryview(raw)
                own = [bytes(view[a : b + LENGTH]) for a, b in zip(lo[keep].tolist(), hi[keep].tolist())]
                anchors = key[keep].view(np.int64)
                yield pa.record_batch(
                    [pa.array(anchors), batch["doc_id"].take(pa.array(text[keep])), pa.array(rows[keep]), pa.array((lo - begin)[keep].astype(np.int32)), pa.array(own, pa.binary()), pa.array(large.has(sent_large.value, anchors))],
                    names=["anchor", "doc_id", "row", "lo", "raw", "large"],
                )

    asked = docs.mapInArrow(spans, f"anchor bigint, doc_id {kind}, row bigint, lo int, raw binary, large boolean")
    grouped = asked.where("not large") if n_many else asked
    out = found.unionByName(grouped.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_compare, f"doc_id {kind}, row bigint, start int, end int"))
    if n_many:
        windows = asked.where("large").mapInArrow(_windows, f"one bigint, two bigint, doc_id {kind}, row bigint, start int")
        windows = staged(windows, "windows")
        twice = windows.groupBy("one", "two").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("one", "two")
        out = out.unionByName(windows.join(twice, ["one", "two"], "left_semi").select("doc_id", "row", "start", (F.col("start") + LENGTH).alias("end")))
    return out


def _cut(batches):
    for big in batches:
        for batch in batches_by_bytes(big, "text", 8_000_000):
            bounds = batch["spans"].to_pylist() if "spans" in batch.schema.names else [None] * batch.num_rows
            rows = []
            for t, spans in zip(pc.fill_null(batch["text"], "").cast(pa.large_binary()).to_pylist(), bounds):
                n_removed = n_spans = at = 0
                kept = hashlib.sha256()
                for s in sorted((x["start"], x["end"]) for x in spans or ()):
                    a, b = max(s[0], at), s[1]
                    if b <= at:
                        continue
                    if s[0] > at or not n_spans:
                        kept.update(t[at:a])
                        n_spans += 1
                    n_removed += b - a
                    at = b
                kept.update(t[at:])
                rows.append((len(t), n_removed, n_spans, kept.hexdigest()))
            yield pa.record_batch([batch["doc_id"], *[pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], pa.array([r[3] for r in rows], pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def remove_repeats(docs: DataFrame, batches: int = BATCHES, group_runs: int = GROUP_RUNS) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    spark = docs.sparkSession
    kind = dict(docs.dtypes)["doc_id"]
    own = plain(docs, "doc_id", "text").withColumn("row", F.xxhash64("doc_id", "text"))
    stretches = repeated_stretches(own.select("doc_id", "row", "text"), batches, group_runs)
    # A document's stretches are at most as many as its bytes.
    spans = staged(stretches.distinct().groupBy("doc_id", "row").agg(F.collect_list(F.struct("start", "end")).alias("spans")), "stretches")
    bloom = Bloom.sized(spans.count(), 16)
    sent = spark.sparkContext.broadcast(build_bloom(spans.select("row"), bloom))

    def chosen(batches, wanted: bool):
        for batch in batches:
            found = bloom.has(sent.value, batch["row"].to_numpy())
            yield batch.filter(pa.array(found if wanted else ~found))

    schema = f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    # Texts without stretches aren't shuffled.
    through = own.mapInArrow(lambda batches: _cut(chosen(batches, False)), schema)
    met = own.mapInArrow(lambda batches: chosen(batches, True), own.schema).alias("d").join(spans.alias("s"), F.col("d.row").eqNullSafe(F.col("s.row")) & F.col("d.doc_id").eqNullSafe(F.col("s.doc_id")), "left")
    met = met.select("d.doc_id", "d.text", "s.spans")
    return through.unionByName(met.mapInArrow(_cut, schema))
