"""N-gram Jaccard join by a MinHash LSH forest.

A document's set is that of its 5-word shingles (a text of 1 to 4 words has one shingle, all its words; a text without words
has none and no links). Documents with the same set form a class of copies, of which one, the smallest doc_id, goes on.

Each representative has TREES paths of DEPTH minima, 16 bits of each. A tree of the forest is the trie of its paths: documents below one
node stand in one sorted run. Matching begins at whole paths. Below each node, documents whose signatures agree as much as links do
are connected, by a spanning forest, not by pairs. Then prefixes are shortened by one minimum, document by document: one that has found links
stops where the forest reaches the target recall at the least similarity among them, any other one where it reaches it at
the threshold, 1 - (1 - s^d)^TREES. Who stopped stays in the tries, to be found by others.

Documents connected in this way form groups, whose sets are intersected exactly: groups are cut into blocks along the
first tree, and two blocks are compared only where they share a node in some tree. A block emits how many links each document has
and the smallest document of its connected part, so pairs are never written out and no link that a block sees is lost.

One row per row of the table: doc_id, class_id (the smallest doc_id that it is connected with by links), copy_id (its
representative), n_links (other rows with a similarity of the threshold or more, its copies included). Repeated rows are
copies; rows that share a doc_id but not their words are linked by it; a null doc_id stands for itself. Empty tables
give no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, Bloom, batches_by_bytes, build_bloom, hot, numbered, passing, place, plain, staged, trimmed, unstage

WORDS = 5
TREES, DEPTH = 24, 8
RECALL = 0.999
#: How far below the threshold the agreement of signatures may be, in standard deviations of the estimate.
MARGIN = 4.5
#: Documents of a block below a node, and of a block of sets; shingles whose columns are multiplied at once.
NODE_BLOCK, BLOCK, COLUMNS = 1024, 1024, 4096
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hash_strings(words: pa.Array) -> np.ndarray:
    """64-bit hashes of strings, by their bytes eight at a time."""
    words = words.cast(pa.large_binary())
    if not len(words):
        return np.zeros(0, np.uint64)
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    raw = np.frombuffer(words.buffers()[2], np.uint8) if words.buffers()[2] else np.zeros(0, np.uint8)
    lengths = np.diff(offsets)
    h = _mix(lengths.astype(np.uint64) + _MIX)
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    todo, at = np.arange(len(lengths)), offsets[:-1].copy()
    left = lengths.copy()
    while len(todo := todo[left[todo] > 0]):
        take = padded[at[todo][:, None] + np.arange(8)]
        take[np.arange(8) >= left[todo][:, None]] = 0
        h[todo] = _mix(h[todo] * _MIX + take.copy().view("<u8").ravel())
        at[todo] += 8
        left[todo] -= 8
    return h


def shingles(texts: pa.Array) -> list[np.ndarray]:
    """Each text's sorted distinct shingle hashes."""
    text = pc.fill_null(texts, "").cast(pa.large_string())
    for c in SPACES[1:]:
        text = pc.replace_substring(text, c, " ")
    split = pc.split_pattern(text, " ")
    flat = split.flatten()
    coded = flat.dictionary_encode()
    word = _hash_strings(coded.dictionary)[coded.indices.to_numpy()] if len(flat) else np.zeros(0, np.uint64)
    some = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False) if len(flat) else np.zeros(0, bool)
    bounds = split.offsets.to_numpy() - split.offsets[0].as_py()
    upto = np.concatenate([[0], np.cumsum(some)])[bounds]
    word = word[some]
    n = np.diff(upto)
    rolled = word.copy()
    for j in range(1, WORDS):
        rolled[: len(word) - j] = _mix(rolled[: len(word) - j] * _MIX + word[j:]) if len(word) > j else rolled[: len(word) - j]
    out = []
    for a, k in zip(upto[:-1].tolist(), n.tolist()):
        if k >= WORDS:
            out.append(np.unique(rolled[a : a + k - WORDS + 1]))
        elif k:
            h = np.array([k], np.uint64)
            for w in word[a : a + k]:
                h = _mix(h * _MIX + w)
            out.append(h)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def reach(similarity: float, depth: int, trees: int = TREES) -> float:
    """The forest's expected recall of pairs of a similarity, by prefixes of a depth."""
    return 1 - (1 - similarity**depth) ** trees


def shallowest(threshold: float, recall: float = RECALL) -> int:
    """The depth at which documents without links stop: the forest reaches the recall at the threshold itself."""
    return next((d for d in range(DEPTH, 1, -1) if reach(threshold, d) >= recall), 1)


_rng = np.random.default_rng(20240229)
_A = _rng.integers(0, 1 << 31, TREES * DEPTH, dtype=np.uint32) << np.uint32(1) | np.uint32(1)
_B = _rng.integers(0, 1 << 32, TREES * DEPTH, dtype=np.uint64).astype(np.uint32)


def signature(own: np.ndarray) -> np.ndarray:
    """The paths of a non-empty set, one tree's DEPTH symbols after the other's."""
    x = (own >> np.uint64(32)).astype(np.uint32)
    best = np.full(TREES * DEPTH, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 256):
        best = np.minimum(best, (x[i : i + 256, None] * _A + _B).min(axis=0))
    # A minimum's high bits are small; mixed, any 16 bits tell it from others.
    return (_mix(best.astype(np.uint64) + _MIX) >> np.uint64(48)).astype(">u2")


def _sign(batches):
    for big in batches:
        for batch in batches_by_bytes(big, "text", 2_000_000):
            sets = shingles(batch["text"])
            key = [_mix(s * _MIX + np.uint64(len(s))) for s in sets]
            k1 = np.array([np.bitwise_xor.reduce(k) ^ np.uint64(len(k)) if len(k) else 0 for k in key], np.uint64).view(np.int64)
            k2 = np.array([k.sum(dtype=np.uint64) if len(k) else 0 for k in key], np.uint64).view(np.int64)
            paths = [signature(s).tobytes() if len(s) else None for s in sets]
            yield pa.record_batch([batch["doc_id"], pa.array([len(s) for s in sets], pa.int32()), pa.array(k1), pa.array(k2), pa.array(paths, pa.binary())], names=["doc_id", "n", "k1", "k2", "paths"])
    trimmed()


def groups_of(batches, keys: list[str]) -> Iterator[pa.Table]:
    """Runs of whole groups, of rows sorted by keys; a group is never cut, and a run ends with a batch at the latest."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch[k].to_numpy() for k in keys]
        ends = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        begin = tuple(c[0] for c in columns)
        if held and begin != last:
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
        if len(ends):
            yield pa.Table.from_batches([*held, batch.slice(0, int(ends[-1]))]).combine_chunks()
            held = []
            batch = batch.slice(int(ends[-1]))
        held.append(batch)
        last = tuple(c[-1] for c in columns)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _connected(sig: np.ndarray, n: np.ndarray, open_: np.ndarray, side: np.ndarray, ids: np.ndarray, threshold: float, least: float) -> list[tuple[int, int, float]]:
    """Edges (and the agreement) of a spanning forest of the documents that may be linked, one of each two being open.

    Documents take their turn by id, so that the nodes of a group in different trees mostly give the same edges.
    """
    within = not side.any()
    label, out = np.arange(len(sig)), []
    turn = np.flatnonzero(open_ if within else side == 0)
    for i in turn[np.argsort(ids[turn], kind="stable")].tolist():
        other = label != label[i]
        if not other.any():
            break
        if not within:
            other &= side == 1
        if not open_[i]:
            other &= open_
        j = np.flatnonzero(other)
        j = j[np.minimum(n[j], n[i]) >= threshold * np.maximum(n[j], n[i]) - 1e-9]
        agree = (sig[j] == sig[i]).mean(axis=1) if len(j) else np.zeros(0)
        hit = agree >= least
        if not hit.any():
            continue
        order = np.argsort(ids[j[hit]], kind="stable")
        j, agree = j[hit][order], agree[hit][order]
        _, first = np.unique(label[j], return_index=True)
        out += [(i, int(j[f]), float(agree[f])) for f in first.tolist()]
        label[np.isin(label, label[j])] = label[i]
    return out


def _match(threshold: float):
    """Over rows (node, bi, bj, side, doc_id, n, open, paths) sorted by node, bi, bj: edges a, b and the signatures' agreement."""
    least = threshold - MARGIN * (threshold * (1 - threshold) / (TREES * DEPTH)) ** 0.5

    def run(batches):
        for rows in groups_of(batches, ["node", "bi", "bj"]):
            node, bi, bj = (rows[c].to_numpy() for c in ("node", "bi", "bj"))
            sig = np.frombuffer(b"".join(rows["paths"].to_pylist()), np.uint16).reshape(-1, TREES * DEPTH)
            n, open_, side, ids = rows["n"].to_numpy(), rows["open"].to_numpy(), rows["side"].to_numpy(), rows["doc_id"].to_numpy()
            cut = np.flatnonzero((node[1:] != node[:-1]) | (bi[1:] != bi[:-1]) | (bj[1:] != bj[:-1])) + 1
            begin = np.concatenate([[0], cut])
            size = np.diff(np.append(begin, len(node)))
            group = np.repeat(np.arange(len(begin)), size)
            a, b, agree = [], [], []
            # Small groups together: each document against the next ones of its group.
            small = (size <= 8)[group] & (bi == bj)
            for k in range(1, 8):
                i = np.flatnonzero(small[:-k] & (group[:-k] == group[k:]))
                i = i[(open_[i] | open_[i + k]) & (np.minimum(n[i], n[i + k]) >= threshold * np.maximum(n[i], n[i + k]) - 1e-9)]
                for part in np.array_split(i, len(i) // 4096 + 1):
                    s = (sig[part] == sig[part + k]).mean(axis=1) if len(part) else np.zeros(0)
                    hit = s >= least
                    a.append(ids[part[hit]])
                    b.append(ids[part[hit] + k])
                    agree.append(s[hit])
            for g in np.flatnonzero((size > 8) | (bi[begin] != bj[begin])).tolist():
                x = slice(int(begin[g]), int(begin[g] + size[g]))
                own = ids[x]
                edges = _connected(sig[x], n[x], open_[x], side[x], own, threshold, least)
                a.append(own[[e[0] for e in edges]])
                b.append(own[[e[1] for e in edges]])
                agree.append(np.array([e[2] for e in edges]))
            found = [np.concatenate(c) for c in (a, b, agree)]
            if len(found[0]):
                ends = [f(found[0], found[1]).astype(np.int64) for f in (np.minimum, np.maximum)]
                yield pa.record_batch([pa.array(ends[0]), pa.array(ends[1]), pa.array(found[2].astype(np.float64))], names=["a", "b", "agree"])
        trimmed()

    return run


def blocked(df: DataFrame, keys: list[str], blocks: str, key: str) -> DataFrame:
    """Each row once for each pair of blocks of its group that its own block is part of: bi, bj, side. Blocks are dealt by a hash of key."""
    dealt = df.withColumn("blk", F.pmod(F.xxhash64(key), F.col(blocks)).cast("int")).withColumn("o", F.explode(F.expr(f"sequence(0, {blocks} - 1)")))
    pair = [F.least("blk", "o").cast("bigint").alias("bi"), F.greatest("blk", "o").cast("bigint").alias("bj"), (F.col("blk") > F.col("o")).cast("int").alias("side")]
    return dealt.select(*[c for c in df.columns if c != blocks], *pair)


def nodes(reps: DataFrame, depth: int, *columns: str) -> DataFrame:
    """The node that each document reaches in each tree by prefixes of a depth."""
    at = reps.select(*columns, "paths", F.explode(F.expr(f"sequence(0, {TREES - 1})")).alias("tree"))
    return at.select(*columns, F.xxhash64("tree", F.expr(f"substring(paths, tree * {2 * DEPTH} + 1, {2 * depth})")).alias("node"))


def forest_edges(reps: DataFrame, threshold: float, recall: float) -> DataFrame:
    """reps (doc_id, n, paths): edges a, b whose connected groups hold all pairs that the forest finds likely to be linked."""
    edges = None
    stopped = None
    for depth in range(DEPTH, shallowest(threshold, recall) - 1, -1):
        marked = reps.withColumn("open", F.lit(True))
        if stopped is not None:
            marked = reps.join(stopped.select("doc_id", F.lit(False).alias("going")), "doc_id", "left").withColumn("open", F.coalesce("going", F.lit(True))).drop("going")
            marked = staged(marked, "marked")
        places = nodes(marked, depth, "doc_id", "open")
        shared = places.groupBy("node").agg(F.count(F.lit(1)).alias("m"), F.max("open").alias("some")).where("m > 1 and some").select("node", "m")
        met = staged(places.join(shared, "node"), "met")
        # Paths go only to documents that share a node; a filter lets few others through to the join.
        held = met.join(passing(reps, "doc_id", met.select("doc_id")), "doc_id").withColumn("nb", F.ceil(F.col("m") / NODE_BLOCK).cast("int")).drop("m")
        spread = blocked(held, ["node"], "nb", "doc_id")
        found = spread.repartition("node", "bi", "bj").sortWithinPartitions("node", "bi", "bj", "paths").mapInArrow(_match(threshold), "a bigint, b bigint, agree double")
        found = staged(found.groupBy("a", "b").agg(F.min("agree").alias("agree")), "forest-edges")
        edges = found if edges is None else edges.unionByName(found)
        unstage(met, marked)
        if depth > shallowest(threshold, recall):
            # The least similarity that its links may have, below which it would have to go on.
            ends = found.select(F.col("a").alias("doc_id"), "agree").unionByName(found.select(F.col("b").alias("doc_id"), "agree"))
            worst = ends.groupBy("doc_id").agg(F.least(F.min("agree"), F.lit(1.0)).alias("s"))
            now = worst.where(1 - F.pow(1 - F.pow("s", F.lit(depth)), F.lit(TREES)) >= recall).select("doc_id")
            stopped = staged(now if stopped is None else now.unionByName(stopped).distinct(), "stopped")
    return edges


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b; bigint) read both ways: node, root, the smallest node connected with it. Nodes without edges don't appear.

    Every node takes the smallest label among itself and its neighbours, then that label's own label, until nothing changes; each
    round is written to the shared folder.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = staged(both, "edges")
    labels = staged(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("root").alias("m"))
        step = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", "root", F.least("root", "m").alias("to"))
        step = staged(step, "step")
        jump = step.join(step.select(F.col("node").alias("to"), F.col("to").alias("further")), "to", "left")
        jump = staged(jump.select("node", "root", F.least("to", F.coalesce("further", F.col("to"))).alias("next")), "labels")
        unstage(labels, step)
        changed = jump.where("next <> root").take(1)
        labels = jump.select("node", F.col("next").alias("root"))
        labels.staged_at = jump.staged_at
        if not changed:
            unstage(both)
            return labels


def _links(sizes: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
    """A matrix [left, right] of whether two sets' similarity reaches the threshold."""
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values, column, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = times > 1  # others are in no intersection
    number = np.cumsum(shared) - 1
    column, owner = number[column[shared[column]]], owner[shared[column]]
    place = np.full(len(sets), -1)
    inter = np.zeros((len(left), len(right)), np.float32)
    for begin in range(0, int(shared.sum()), COLUMNS):
        inside = (column >= begin) & (column < begin + COLUMNS)
        width = min(COLUMNS, int(shared.sum()) - begin)

        def filled(rows):
            place[:] = -1
            place[rows] = np.arange(len(rows))
            at = place[owner[inside]]
            m = np.zeros((len(rows), width), np.float32)
            m[at[at >= 0], column[inside][at >= 0] - begin] = 1
            return m

        x = filled(left)
        y = x if right is left else filled(right)
        inter += x @ y.T
    union = sizes[left][:, None] + sizes[right][None, :] - inter
    return (inter > 0) & (inter >= threshold * union - 1e-3)


def _parts(linked: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The smallest id of each document's connected part."""
    label = ids.copy()
    high = np.iinfo(np.int64).max
    while True:
        near = np.minimum(label, np.where(linked, label[None, :], high).min(axis=1))
        if (near == label).all():
            return label
        label = near


def _verify(threshold: float):
    """Over rows (grp, bi, bj, side, doc_id, copies, raw) sorted by grp, bi, bj: doc_id, n_links, part (its part's smallest document)."""

    def emit(rows: pa.Table):
        sets = [np.frombuffer(r, np.uint64) for r in rows["raw"].to_pylist()]
        sizes = np.array([len(s) for s in sets])
        ids, copies, side = rows["doc_id"].to_numpy(), rows["copies"].to_numpy(), rows["side"].to_numpy()
        within = rows["bi"][0].as_py() == rows["bj"][0].as_py()
        left = np.flatnonzero(side == 0)
        right = left if within else np.flatnonzero(side == 1)
        if not len(left) or not len(right) or within and len(left) < 2:
            return None
        linked = _links(sizes, sets, left, right, threshold)
        if within:
            np.fill_diagonal(linked, False)
            own, n, label = ids[left], linked @ copies[left].astype(np.float64), _parts(linked, ids[left])
        else:
            own = np.concatenate([ids[left], ids[right]])
            n = np.concatenate([linked @ copies[right].astype(np.float64), copies[left].astype(np.float64) @ linked])
            both = np.zeros((len(own), len(own)), bool)
            both[: len(left), len(left) :], both[len(left) :, : len(left)] = linked, linked.T
            label = _parts(both, own)
        some = n > 0
        return pa.record_batch([pa.array(own[some]), pa.array(n[some].astype(np.int64)), pa.array(label[some])], names=["doc_id", "n_links", "part"])

    def run(batches):
        for rows in groups_of(batches, ["grp", "bi", "bj"]):
            grp, bi, bj = (rows[c].to_numpy() for c in ("grp", "bi", "bj"))
            ends = [*(np.flatnonzero((grp[1:] != grp[:-1]) | (bi[1:] != bi[:-1]) | (bj[1:] != bj[:-1])) + 1).tolist(), len(grp)]
            at = 0
            for end in ends:
                if (out := emit(rows.slice(at, end - at).combine_chunks())) is not None:
                    yield out
                at = end
        trimmed()

    return run


def _dealt(groups: DataFrame, reps: DataFrame, floor: int) -> DataFrame:
    """grp, bi, bj, side, doc_id: documents of groups of one block once, others once for each pair of blocks that share a node.

    Blocks follow the first tree's nodes; a node of more than BLOCK documents, about, is cut by a hash of the document.
    """
    sizes = groups.groupBy("grp").agg(F.count(F.lit(1)).alias("m"))
    sized = groups.join(sizes, "grp")
    one = sized.where(F.col("m") <= BLOCK).select("grp", F.lit(0).cast("bigint").alias("bi"), F.lit(0).cast("bigint").alias("bj"), F.lit(0).alias("side"), "doc_id")
    large = sized.where(F.col("m") > BLOCK).join(reps.select("doc_id", "paths"), "doc_id")
    large = large.withColumn("cell", F.pmod(F.xxhash64(F.expr(f"substring(paths, 1, {2 * floor})")), F.ceil(F.col("m") / BLOCK)))
    cells = large.groupBy("grp", "cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("cuts"))
    large = large.join(cells, ["grp", "cell"]).withColumn("blk", F.col("cell") * (1 << 24) + F.pmod(F.xxhash64("doc_id"), F.col("cuts")))
    large = staged(large.select("grp", "blk", "doc_id", "paths"), "large-groups")
    spots = nodes(large, floor, "grp", "blk").distinct()
    pairs = spots.alias("x").join(spots.alias("y"), F.expr("x.grp = y.grp and x.node = y.node and x.blk < y.blk")).select("x.grp", F.col("x.blk").alias("bi"), F.col("y.blk").alias("bj")).distinct()
    own = large.select("grp", "blk").distinct().select("grp", F.col("blk").alias("bi"), F.col("blk").alias("bj"))
    sides = pairs.unionByName(own)
    sides = staged(sides.select("*", F.col("bi").alias("blk"), F.lit(0).alias("side")).unionByName(sides.where("bi < bj").select("*", F.col("bj").alias("blk"), F.lit(1).alias("side"))), "block-pairs")
    return one.unionByName(large.select("grp", "blk", "doc_id").join(sides, ["grp", "blk"]).select("grp", "bi", "bj", "side", "doc_id"))


def near_duplicates(docs: DataFrame, threshold: float = 0.8, recall: float = RECALL) -> DataFrame:
    """doc_id, class_id, copy_id, n_links for each row of docs (doc_id: whole numbers)."""
    spark = docs.sparkSession
    own = plain(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("bigint"))
    signed = staged(own.mapInArrow(_sign, "doc_id bigint, n int, k1 bigint, k2 bigint, paths binary"), "signed")
    copies = signed.where("n > 0 and doc_id is not null").groupBy("n", "k1", "k2").agg(F.min("doc_id").alias("copy_id"), F.count(F.lit(1)).alias("copies"))
    copies = staged(copies, "copies")
    first = signed.where("n > 0").select("doc_id", "n", "k1", "k2", "paths").join(copies.select("n", "k1", "k2", F.col("copy_id").alias("doc_id")), ["n", "k1", "k2", "doc_id"], "left_semi")
    reps = staged(first.dropDuplicates(["doc_id"]).select("doc_id", "n", "paths"), "signatures")
    groups = components(forest_edges(reps, threshold, recall).select("a", "b"))
    groups = staged(groups.withColumnRenamed("node", "doc_id").withColumnRenamed("root", "grp"), "candidate-groups")

    # The sets of candidates only, from a second reading of their texts; the filter lets few others through.
    bloom = Bloom.sized(groups.count(), 16)
    sent = spark.sparkContext.broadcast(build_bloom(groups.select("doc_id"), bloom))

    def sets_of(batches):
        for big in batches:
            big = big.filter(pc.is_valid(big["doc_id"]))
            big = big.filter(pa.array(bloom.has(sent.value, big["doc_id"].to_numpy())))
            for batch in batches_by_bytes(big, "text", 2_000_000):
                yield pa.record_batch([batch["doc_id"], pa.array([s.tobytes() for s in shingles(batch["text"])], pa.binary())], names=["doc_id", "raw"])
        trimmed()

    raw = own.mapInArrow(sets_of, "doc_id bigint, raw binary")
    raw = raw.join(copies.groupBy(F.col("copy_id").alias("doc_id")).agg(F.sum("copies").alias("copies")), "doc_id").join(groups.select("doc_id"), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    raw = staged(raw, "candidate-sets")
    spread = _dealt(groups, reps, shallowest(threshold, recall)).join(raw, "doc_id")
    verified = spread.repartition("grp", "bi", "bj").sortWithinPartitions("grp", "bi", "bj").mapInArrow(_verify(threshold), "doc_id bigint, n_links bigint, part bigint")
    verified = staged(verified, "verified")
    unstage(raw, groups)
    counts = verified.groupBy("doc_id").agg(F.sum("n_links").alias("links"))
    classes = components(verified.select(F.col("doc_id").alias("a"), F.col("part").alias("b")))
    by = copies.join(counts.withColumnRenamed("doc_id", "copy_id"), "copy_id", "left").join(classes.select(F.col("node").alias("copy_id"), "root"), "copy_id", "left")
    by = staged(by.select("n", "k1", "k2", "copy_id", "copies", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "copy_id").alias("class_id")), "representatives")
    single = signed.where("n = 0 or doc_id is null").select("doc_id", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("copy_id"), F.lit(0).cast("bigint").alias("n_links"))
    # Rows without copies are their own representatives. Classes of very many copies, which are few, are sent to all rows of theirs.
    rows = signed.where("n > 0 and doc_id is not null").select("doc_id", "n", "k1", "k2")
    large = hot(by, "copies").withColumn("large", F.lit(True))
    met = rows.join(F.broadcast(large), ["n", "k1", "k2"], "left")
    done = met.where("large").select("doc_id", "class_id", "copy_id", "n_links")
    rest = met.where("large is null").select("doc_id", "n", "k1", "k2").join(by, ["n", "k1", "k2"]).select("doc_id", "class_id", "copy_id", "n_links")
    return single.unionByName(done).unionByName(rest)


def keep_one(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """docs without the rows that aren't their class's first; rows that repeat that doc_id stay with it. Texts without words all stay."""
    dropped = near_duplicates(docs, threshold).where("class_id <> doc_id").select(F.col("doc_id").alias("gone")).distinct()
    dropped = staged(dropped, "dropped")
    bloom = Bloom.sized(dropped.count(), 16)
    sent = docs.sparkSession.sparkContext.broadcast(build_bloom(dropped, bloom))
    keyed = numbered(docs).withColumn("key", F.col(place(docs, "doc_id")).cast("bigint"))

    def split(wanted: bool):
        def run(batches):
            for batch in batches:
                ids = pc.fill_null(batch["key"], 0).to_numpy()
                found = bloom.has(sent.value, ids) & pc.is_valid(batch["key"]).to_numpy(zero_copy_only=False)
                yield batch.filter(pa.array(found if wanted else ~found))

        return keyed.mapInArrow(run, keyed.schema)

    # Only rows that the filter holds for dropped are looked up; all others pass without a shuffle.
    stays = split(True).join(dropped, F.col("key") == F.col("gone"), "left_anti")
    return split(False).drop("key").unionByName(stays.drop("key")).toDF(*docs.columns)
