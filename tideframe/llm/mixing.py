"""Mixing sources to target weights, fitted by subset sums.

Each source's target is a share of a budget, no more than `most` times its size; what a source can't take is shared
again among the others. A source's documents are taken whole times as often as its target holds its size; the rest of the
target is a subset sum: documents are counted by exact length, each length first gives its proportional share, and a
bounded-knapsack dynamic program over the lengths' remaining counts fits what is left. Which documents of a length are
taken is decided by a seeded hash, so reruns agree.

A document's length is its number of words (runs of other than ASCII white space; null text has none). Null is a source
of its own and comes last. Rows that repeat a doc_id count each; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import numbered, place, plain, staged

#: Widest remaining budget that the dynamic program covers, in tokens.
TABLE = 1 << 16
#: Units of a room that a length needs to be fitted in them.
LONG = 16
#: Documents of one length and source among which one task ranks, about.
RANKED = 250
#: Pairs of a source and a length whose counts are broadcast, at most: about 25 MB.
DECISIONS = 1 << 18


def word_count(text: str = "text"):
    return F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def targets(sizes: Sequence[int], weights: Sequence[float], budget: float, most: float = 2.0) -> list[float]:
    """Shares of the budget by weight, none above most times its size; the excess goes to the others by weight."""
    out, open_ = [0.0] * len(sizes), set(range(len(sizes)))
    left = float(budget)
    while open_:
        total = sum(weights[i] for i in open_)
        share = {i: left * weights[i] / total for i in open_}
        full = [i for i in open_ if share[i] > most * sizes[i]]
        if not full:
            for i in open_:
                out[i] = share[i]
            break
        for i in full:
            out[i] = float(most * sizes[i])
            left -= out[i]
            open_.discard(i)
    return out


def _best_sum(lengths: np.ndarray, counts: np.ndarray, room: int) -> np.ndarray:
    """How many of each length to take, so that they sum to as much of the room as they can: a bounded-knapsack program."""
    take = counts * 0
    # Reachable sums as the bits of a number, one number after each bundle of 1, 2, 4 ... documents of a length.
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        rest, k = int(min(counts[i], room // max(1, size))), 1
        while rest > 0 and not reach >> room & 1:
            n = min(k, rest)
            steps.append((i, n, reach))
            reach |= reach << (n * size) & mask
            rest -= n
            k *= 2
        if reach >> room & 1:
            break
    at = reach.bit_length() - 1
    for i, n, before in reversed(steps):
        if not before >> at & 1:
            take[i] += n
            at -= n * int(lengths[i])
    return take


def fit_counts(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length (positive, distinct) to take, so that they sum to at most budget, as near as found.

    Each length gives its share of the budget rounded down. While more than TABLE is left, the room is counted in TABLE units: lengths of LONG
    units and more are fitted by the program, rounded up; where there are only shorter ones, they are given from the longest down, so
    that half a TABLE stays. Within TABLE the program is exact.
    """
    total = int((lengths * counts).sum())
    if budget >= total:
        return counts.copy()
    take = counts * budget // total if total else counts * 0
    left = budget - int((take * lengths).sum())
    while left > TABLE:
        unit = -(-left // TABLE)
        may = np.minimum(counts - take, left // lengths)
        long = np.flatnonzero((may > 0) & (lengths >= LONG * unit))
        more = counts * 0
        if len(long):
            more[long] = _best_sum(-(-lengths[long] // unit), may[long], left // unit)
        else:
            rest = left - TABLE // 2
            for i in np.argsort(-lengths, kind="stable").tolist():
                more[i] = max(0, min(int(may[i]), rest // int(lengths[i])))
                rest -= int(more[i]) * int(lengths[i])
        if not more.any():  # rounded up, nothing fits: the longest that does
            if not may.any():
                return take
            more[max(np.flatnonzero(may).tolist(), key=lambda i: int(lengths[i]))] = 1
        take = take + more
        left -= int((more * lengths).sum())
    return take + _best_sum(lengths, np.minimum(counts - take, left // lengths), left)


def _order(seed: int) -> Column:
    return F.xxhash64("doc_id", F.lit(seed))


def _cell(order: Column) -> Column:
    """The cell of a document among the ceil(n / RANKED) cells of its length, by its order as a share of all orders."""
    return F.floor((F.shiftrightunsigned(order, 1).cast("double") / float(1 << 63)) * F.ceil(F.col("n") / RANKED))


class _Fit:
    """What a mix decides on: sized rows, a plan for each source, counts for each length, and where a length's count runs out."""

    def __init__(self, docs: DataFrame, weights: Sequence[float], share: float, most: int, seed: int):
        sized = staged(plain(docs, "doc_id", "source", "text").select("doc_id", "source", word_count().alias("size")).withColumn("row", F.monotonically_increasing_id()), "sizes")
        # A row for each source; sources are names of collections, of which there are few beside documents.
        totals = sized.groupBy("source").agg(F.sum("size").alias("n")).collect()
        totals.sort(key=lambda r: (r.source is None, (r.source or "").encode("utf-32-be")))
        sizes = [int(r.n) for r in totals]
        goal = targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))], share * sum(sizes), most)
        rows = []
        for i, (r, size, target) in enumerate(zip(totals, sizes, goal)):
            whole = min(most, int(target // size)) if size else 0
            rows.append((i, r.source, size, target, whole, int(round(target)) - whole * size if whole < most else 0))
        self.plan = docs.sparkSession.createDataFrame(rows, "sid int, source string, source_size bigint, target double, whole int, rest bigint")

        counts = sized.join(F.broadcast(self.plan.select("sid", "source", "rest")), sized["source"].eqNullSafe(self.plan["source"])).drop(self.plan["source"])
        by_length = counts.where("size > 0 and rest > 0").groupBy("sid", "rest", "size").agg(F.count(F.lit(1)).alias("n"))

        def fit(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("size").reset_index(drop=True)
            pdf["take"] = fit_counts(pdf["size"].to_numpy(), pdf["n"].to_numpy(), int(pdf["rest"][0]))
            return pdf[["sid", "size", "n", "take"]]

        #: sid, size, n, take
        self.lengths = staged(by_length.groupBy("sid").applyInPandas(fit, "sid int, size bigint, n bigint, take bigint"), "length-counts")
        self.rows = counts.drop("rest").join(self.lengths, ["sid", "size"], "left").withColumn("order", _order(seed))
        # Where a length gives only some of its documents, these are the first by hash: cells of about RANKED documents are counted,
        # and only the cell in which the count runs out is ranked.
        some = self.rows.where("take > 0 and take < n").withColumn("cell", _cell(F.col("order")))
        per_cell = some.groupBy("sid", "size", "cell", "take").agg(F.count(F.lit(1)).alias("m"))
        run = Window.partitionBy("sid", "size").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
        per_cell = per_cell.withColumn("upto", F.sum("m").over(run))
        last = staged(per_cell.where("upto >= take and upto - m < take").select("sid", "size", F.col("cell").alias("last"), (F.col("take") - F.col("upto") + F.col("m")).alias("within")), "last-cells")
        #: Rows of lengths that give some, with last and within; of these, the ranked rows of the last cells
        self.some = some.join(last, ["sid", "size"])
        self.ranked = self.some.where("cell = last").withColumn("rank", F.row_number().over(Window.partitionBy("sid", "size", "cell").orderBy("order", F.col("doc_id").asc_nulls_last(), "row")))


def _plan_rows(fit: _Fit) -> DataFrame:
    some, ranked = fit.some, fit.ranked
    extra = some.where("cell < last").select("sid", "source", "size", "doc_id", "row", F.lit(1).alias("extra")).unionByName(
        ranked.select("sid", "source", "size", "doc_id", "row", (F.col("rank") <= F.col("within")).cast("int").alias("extra"))
    ).unionByName(some.where("cell > last").select("sid", "source", "size", "doc_id", "row", F.lit(0).alias("extra")))
    plainly = fit.rows.where("take is null or take = 0 or take = n").select("sid", "source", "size", "doc_id", "row", F.when(F.col("take") == F.col("n"), 1).otherwise(0).alias("extra"))
    return (
        plainly.unionByName(extra)
        .join(F.broadcast(fit.plan.drop("source", "rest")), "sid")
        .withColumn("times", F.when(F.col("size") > 0, F.col("whole") + F.col("extra")).otherwise(0))
    )


def plan_mix(docs: DataFrame, weights: Sequence[float] = (3.0, 1.0, 2.0), share: float = 1.5, most: int = 2, seed: int = 1) -> DataFrame:
    """One row per row of docs: doc_id, size, source_size, target (its source's), times (how often it is taken), taken (words).

    Sources, sorted by code point with null last, have the weights in turn.
    """
    rows = _plan_rows(_Fit(docs, weights, share, most, seed))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"), "times")


def mix_documents(docs: DataFrame, weights: Sequence[float] = (3.0, 1.0, 2.0), share: float = 1.5, most: int = 2, seed: int = 1, decisions: int = DECISIONS) -> DataFrame:
    """docs with each row as often as the mix takes it; all columns as they were.

    Rows that share doc_id, source and length are taken together. Where there are at most `decisions` pairs of a source and a length, each
    pair's count and the last document that it takes are sent to all tasks, and texts don't move; where there are more, rows
    meet their plan by a shuffle. Both give the same rows.
    """
    fit = _Fit(docs, weights, share, most, seed)
    own = numbered(docs)
    helpers = own.select("*", F.col(place(docs, "doc_id")).alias("doc_id"), F.col(place(docs, "source")).alias("source"), word_count(place(docs, "text")).alias("size"))
    if fit.lengths.count() <= decisions:
        edges = fit.ranked.where("rank = within").select("sid", "size", "last", F.col("order").alias("at"), F.col("doc_id").alias("at_id"))
        lengths = staged(fit.lengths.where("take > 0").join(edges, ["sid", "size"], "left"), "mix-lengths")
        sent = F.broadcast(fit.plan.select("sid", F.col("source").alias("of"), "whole"))
        met = helpers.join(sent, F.col("source").eqNullSafe(F.col("of"))).join(F.broadcast(lengths), ["sid", "size"], "left").withColumn("order", _order(seed))
        upto = F.col("at_id").isNull() | F.coalesce(F.col("doc_id") <= F.col("at_id"), F.lit(False))
        within = (F.col("order") < F.col("at")) | (F.col("order") == F.col("at")) & upto
        cell = _cell(F.col("order"))
        extra = F.when(F.col("take").isNull(), 0).when(F.col("take") == F.col("n"), 1).when(cell < F.col("last"), 1).when((cell == F.col("last")) & within, 1).otherwise(0)
        timed = met.withColumn("times", F.when(F.col("size") > 0, F.col("whole") + extra).otherwise(0)).where("times > 0")
    else:
        # Of a length that gives only some, rows that share a doc_id may lie on both sides of the last one taken: they go with the first.
        by = _plan_rows(fit).groupBy(F.col("doc_id").alias("p_id"), F.col("source").alias("p_source"), F.col("size").alias("p_size")).agg(F.max("times").alias("times")).where("times > 0")
        timed = helpers.join(by, F.col("doc_id").eqNullSafe(F.col("p_id")) & F.col("source").eqNullSafe(F.col("p_source")) & (F.col("size") == F.col("p_size")))
    return timed.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times")))).select(*own.columns).toDF(*docs.columns)
