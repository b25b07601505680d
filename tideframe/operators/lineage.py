"""Supersedes relations as a graph: edges run from predecessor to successor."""

from __future__ import annotations

import contextlib
import hashlib
import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import files
from ..functions.encoding import canonical_json
from .cut import materialized

# Fixed format names of the documents.
RELATION_FORMAT = "qrt-dataset-supersedes/1"
INDEX_FORMAT = "qrt-lineage-index/1"


class LineageError(ValueError):
    """A relation or a graph of them that can't stand."""


class LineageCycle(LineageError):
    """A relation that would make a dataset its own ancestor."""


class MissingRelation(LineageError):
    """No relation of that hash."""


class LineageIndexError(LineageError):
    """An index that isn't what the relations say."""


class RelationHashMismatch(LineageError):
    """A document that isn't what its name or its own hash says."""


@dataclass(frozen=True)
class Relation:
    successor: str
    predecessors: tuple[str, ...]

    def payload(self) -> dict[str, Any]:
        return {"format": RELATION_FORMAT, "successor_manifest_hash": self.successor, "predecessor_manifest_hashes": sorted(self.predecessors), "provenance": {"kind": "operator-declared"}}

    @property
    def hash(self) -> str:
        return hashlib.sha256(canonical_json(self.payload())).hexdigest()

    def document(self) -> bytes:
        return canonical_json(self.payload() | {"relation_hash": self.hash})


def build_relation(successor: str, predecessors: list[str]) -> Relation:
    for h in (successor, *predecessors):
        if not re.fullmatch("[0-9a-f]{64}", h):
            raise LineageError(f"not a manifest hash: {h!r}")
    if not predecessors or len(set(predecessors)) < len(predecessors):
        raise LineageError("predecessors must be some, and each one once")
    if successor in predecessors:
        raise LineageError("a dataset can't supersede itself")
    return Relation(successor, tuple(sorted(predecessors)))


def parse_relation(raw: bytes) -> Relation:
    """The relation of a document that is, byte for byte, what it would be written as."""
    import json

    try:
        doc = json.loads(raw)
        out = build_relation(doc["successor_manifest_hash"], doc["predecessor_manifest_hashes"])
    except (KeyError, TypeError, json.JSONDecodeError) as e:
        raise RelationHashMismatch(f"unreadable relation: {e}") from e
    if out.document() != raw:
        raise RelationHashMismatch("the relation isn't in canonical form or its hash differs")
    return out


def validate_relation(successor: dict[str, str], predecessors: list[dict[str, str]]) -> None:
    """Manifests as dicts: a correction has the same record type and contract as what it corrects, and other contents."""
    for p in predecessors:
        if p["record_type"] != successor["record_type"] or p["contract"] != successor["contract"]:
            raise LineageError("record type and contract must be those of the predecessor")
        if p["semantic_hash"] == successor["semantic_hash"]:
            raise LineageError("a correction that changes nothing")


def edges_of(relations: DataFrame) -> DataFrame:
    """relations (successor, predecessors array, relation_hash): a, b, relation_hash for each edge."""
    return relations.select(F.explode("predecessors").alias("a"), F.col("successor").alias("b"), "relation_hash")


def successors(edges: DataFrame, node: object) -> DataFrame:
    return edges.where(F.col("a") == node).select(F.col("b").alias("node")).distinct().orderBy("node")


def predecessors(edges: DataFrame, node: object) -> DataFrame:
    return edges.where(F.col("b") == node).select(F.col("a").alias("node")).distinct().orderBy("node")


def reachable(edges: DataFrame, starts: DataFrame, backwards: bool = False) -> DataFrame:
    """start, node for every node that each start leads to; a start is among them only if it lies on a cycle.

    Where no node has two steps and at least half of them are asked for, their chains are put together; see _chains().
    Else semi-naive: each round joins only the pairs that the last one found new, so cycles end by themselves and shared paths are walked
    once, and paths may be of any length. Each round is a checkpoint, and two of them become one where the later isn't the smaller, so a
    pair is written again as often as its table doubles, not in each round.
    """
    step = materialized(edges.select(F.col("b" if backwards else "a").alias("from"), F.col("a" if backwards else "b").alias("to")).where("from is not null").distinct())
    asked = step.join(starts.toDF("start").distinct(), F.col("from") == F.col("start"), "left_semi")
    if step.groupBy("from").count().where("count > 1").isEmpty() and 2 * asked.count() >= step.count():
        return _chains(step, asked)
    new = materialized(asked.select(F.col("from").alias("start"), F.col("to").alias("node")))
    every, sizes = [new], [new.count()]
    while sizes[-1]:
        found = new.join(step, F.col("node") == F.col("from")).select("start", F.col("to").alias("node")).distinct()
        new = materialized(found.join(reduce(DataFrame.unionByName, every), ["start", "node"], "left_anti"))
        every, sizes = [*every, new], [*sizes, new.count()]
        while len(sizes) > 1 and sizes[-1] and sizes[-2] <= sizes[-1]:
            every[-2:], sizes[-2:] = [materialized(every[-2].unionByName(every[-1]))], [sizes[-2] + sizes[-1]]
    return reduce(DataFrame.unionByName, every)


def _chains(step: DataFrame, asked: DataFrame) -> DataFrame:
    """reachable() where each node has one step at most. asked: the steps (from, to) of the starts.

    `at` has nodes, the nodes that their next 1, 2, 4 and so on steps lead to, and the last of these, null where the chain ends or has met
    itself. Only nodes that are the last of others are carried on, with twice the steps; so there is a round for each doubling of the
    longest chain, and where chains meet, tables shrink. Then each table's chains are continued by those of the next. Only the rounds
    are kept; chains are put together while the result is read.
    """
    single = lambda df: df.select(F.col("from").alias("node"), F.array("to").alias("chain"), F.when(F.col("to") != F.col("from"), F.col("to")).alias("last"))
    at, seen = single(step), [single(asked)]
    while True:
        needed = at.select(F.col("last").alias("node")).where("node is not null").distinct()
        own = at.join(needed, "node", "left_semi")
        on = at.select(F.col("node").alias("last"), F.col("chain").alias("more"), F.col("last").alias("next"))
        both = own.join(on.join(needed.toDF("last"), "last", "left_semi"), "last", "left").select("node", "chain", "more", "next")
        both = both.withColumn("whole", F.when(F.col("more").isNull(), F.col("chain")).otherwise(F.concat("chain", "more")))
        both = both.withColumn("met", F.array_distinct("whole"))
        at = materialized(both.select("node", F.col("met").alias("chain"), F.when(F.size("met") == F.size("whole"), F.col("next")).alias("last")))
        if at.isEmpty():
            break
        seen.append(at)
    rest = seen.pop().select("node", "chain")
    for at in reversed(seen):
        met = at.join(rest.toDF("last", "more"), "last", "left")
        rest = met.select("node", F.when(F.col("more").isNull(), F.col("chain")).otherwise(F.array_distinct(F.concat("chain", "more"))).alias("chain"))
    return rest.select(F.col("node").alias("start"), F.explode("chain").alias("node"))


RECURSIVE = """
WITH RECURSIVE walk(start, node, path, closed) AS (
  SELECT s.start, e.b, array(s.start, e.b), e.b = s.start FROM {starts} s JOIN {edges} e ON e.a = s.start
  UNION ALL
  SELECT w.start, e.b, concat(w.path, array(e.b)), array_contains(w.path, e.b) FROM walk w JOIN {edges} e ON e.a = w.node WHERE NOT w.closed
)
SELECT DISTINCT start, node FROM walk
"""


def reachable_sql(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """The same by one recursive query, for small graphs: every path is walked, and a path that meets itself ends."""
    return edges.sparkSession.sql(RECURSIVE, edges=edges.select("a", "b").distinct(), starts=starts.toDF("start"))


def _trimmed(edges: DataFrame) -> DataFrame:
    """edges without nodes that have no way in or no way out, again and again: they lie on no cycle."""
    left = materialized(edges)
    n = left.count()
    while n:
        into, out = left.select(F.col("b").alias("x")).distinct(), left.select(F.col("a").alias("x")).distinct()
        left = materialized(left.join(into, F.col("a") == F.col("x"), "left_semi").join(out, F.col("b") == F.col("x"), "left_semi"))
        before, n = n, left.count()
        if n == before:
            break
    return left


def on_cycles(edges: DataFrame) -> DataFrame:
    """Nodes that lead to themselves, by strongly connected components: one label for each node, never all pairs.

    Each node takes the largest node that leads to it; who is its own label is a root, and what leads to a root within its label is its
    component. Components go, and what is left is labelled again.
    """
    left, found = _trimmed(edges.select("a", "b").distinct()), None
    while not left.isEmpty():
        nodes = left.select(F.col("a").alias("node")).unionByName(left.select(F.col("b").alias("node"))).distinct()
        labels = materialized(nodes.withColumn("label", F.col("node")))
        while True:
            into = left.join(labels, F.col("a") == F.col("node")).groupBy(F.col("b").alias("to")).agg(F.max("label").alias("more"))
            step = materialized(labels.join(into, F.col("node") == F.col("to"), "left").select("node", "label", F.greatest("label", F.coalesce("more", "label")).alias("next")))
            labels = step.select("node", F.col("next").alias("label"))
            if step.where("next <> label").isEmpty():
                break
        own = left.join(labels.toDF("a", "la"), "a").join(labels.toDF("b", "lb"), "b").where("la = lb").select("a", "b", F.col("la").alias("label"))
        own = materialized(own)
        inside = materialized(labels.where("node = label"))
        new = inside
        while not new.isEmpty():
            back = own.join(new.select(F.col("node").alias("b"), "label"), ["b", "label"]).select(F.col("a").alias("node"), "label").distinct()
            new = materialized(back.join(inside, ["node", "label"], "left_anti"))
            inside = materialized(inside.unionByName(new))
        size = inside.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
        loops = left.where("a = b").select(F.col("a").alias("node")).distinct()
        cyclic = inside.join(size, "label").where("size > 1").select("node").unionByName(inside.select("node").join(loops, "node", "left_semi")).distinct()
        found = materialized(cyclic if found is None else found.unionByName(cyclic))
        gone = inside.select("node").distinct()
        left = _trimmed(left.join(gone, F.col("a") == F.col("node"), "left_anti").join(gone, F.col("b") == F.col("node"), "left_anti"))
    return (found if found is not None else edges.select(F.col("a").alias("node")).where("false")).orderBy("node")


def find_cycle(edges: list[tuple[str, str]]) -> list[str] | None:
    """A path that ends where it begins, for one message; the smallest names first."""
    out: dict[str, list[str]] = {}
    for a, b in sorted(set(edges)):
        out.setdefault(a, []).append(b)
    done: set[str] = set()
    for start in sorted(out):
        path, todo = [], [(start, iter(out.get(start, ())))]
        if start in done:
            continue
        path.append(start)
        while todo:
            nxt = next(todo[-1][1], None)
            if nxt is None:
                done.add(path.pop())
                todo.pop()
            elif nxt in path:
                return path[path.index(nxt) :] + [nxt]
            elif nxt not in done:
                path.append(nxt)
                todo.append((nxt, iter(out.get(nxt, ()))))
    return None


def index(edges: DataFrame) -> DataFrame:
    """manifest_hash, relations: the sorted hashes of the relations that each manifest takes part in."""
    both = edges.select(F.col("a").alias("manifest_hash"), "relation_hash").unionByName(edges.select(F.col("b").alias("manifest_hash"), "relation_hash"))
    return both.groupBy("manifest_hash").agg(F.array_sort(F.collect_set("relation_hash")).alias("relations"))


def index_document(rows: list[tuple[str, list[str]]]) -> bytes:
    return canonical_json({"format": INDEX_FORMAT, "entries": [{"manifest_hash": m, "relation_hashes": sorted(r)} for m, r in sorted(rows)]})


def relations_folder(root: str) -> str:
    return files.join(root, "lineage")


def published(root: str) -> list[Relation]:
    """All relations of a catalog, by hash, each held against its name and its own bytes."""
    out = []
    for name in files.names(relations_folder(root), ".json"):
        found = parse_relation(files.read(files.join(relations_folder(root), name)))
        if f"{found.hash}.json" != name:
            raise RelationHashMismatch(name)
        out.append(found)
    return out


def read_relation(root: str, digest: str) -> Relation:
    path = files.join(relations_folder(root), f"{digest}.json")
    if not files.exists(path):
        raise MissingRelation(digest)
    found = parse_relation(files.read(path))
    if found.hash != digest:
        raise RelationHashMismatch(digest)
    return found


def pairs_of(relations: list[Relation]) -> list[tuple[str, str]]:
    return [(p, r.successor) for r in relations for p in r.predecessors]


def verify_acyclic(root: str) -> None:
    if cycle := find_cycle(pairs_of(published(root))):
        raise LineageCycle(" to ".join(cycle))


def publish_relation(root: str, relation: Relation, manifest: Callable[[str], dict[str, str]]) -> bool:
    """Adds a relation between published manifests (manifest gives one by hash, or fails) and refreshes the index; False if it was there.

    A catalog that already has a cycle takes nothing, and no relation may make one. The index can be derived again, so its loss is no
    failure.
    """
    from .catalog import publish

    verify_acyclic(root)
    validate_relation(manifest(relation.successor), [manifest(p) for p in relation.predecessors])
    if cycle := find_cycle(pairs_of([*published(root), relation])):
        raise LineageCycle(" to ".join(cycle))
    new = publish(files.join(relations_folder(root), f"{relation.hash}.json"), relation.document())
    with contextlib.suppress(OSError):
        rebuild_index(root)
    return new


def index_rows(relations: list[Relation]) -> list[tuple[str, list[str]]]:
    out: dict[str, set[str]] = {}
    for r in relations:
        for m in (r.successor, *r.predecessors):
            out.setdefault(m, set()).add(r.hash)
    return [(m, sorted(h)) for m, h in sorted(out.items())]


def rebuild_index(root: str) -> bytes:
    """The index as the relations themselves say, written whole or not at all."""
    raw = index_document(index_rows(published(root)))
    files.write(files.join(root, "lineage-index.json"), raw)
    return raw


def verify_index(root: str) -> None:
    path = files.join(root, "lineage-index.json")
    held = files.read(path) if files.exists(path) else index_document([])
    if held != index_document(index_rows(published(root))):
        raise LineageIndexError("the index isn't what the relations say")


def partials(root: str) -> list[str]:
    """Files that a broken-off publication left."""
    return files.names(relations_folder(root), ".partial")
