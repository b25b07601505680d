"""Two datasets held against each other: as multisets of rows, as sequences, and, for bars, by period."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class NotComparable(ValueError):
    """The datasets' record types or contracts differ."""


class AmbiguousKey(ValueError):
    """A dataset has two bars for one period."""


def multiset(left: DataFrame, right: DataFrame, *columns: str) -> DataFrame:
    """One row: left_rows, right_rows, overlap, left_only, right_only, same_multiset. Rows are counted on each side before they meet."""
    one = left.groupBy(*columns).agg(F.count(F.lit(1)).alias("l"))
    two = right.groupBy(*columns).agg(F.count(F.lit(1)).alias("r"))
    met = one.withColumn("r", F.lit(0).cast("bigint")).unionByName(two.withColumn("l", F.lit(0).cast("bigint")))
    met = met.groupBy(*columns).agg(F.sum("l").alias("l"), F.sum("r").alias("r"))  # a union and not a join, so that nulls are equal
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(name)
    out = met.agg(total(F.col("l"), "left_rows"), total(F.col("r"), "right_rows"), total(F.least("l", "r"), "overlap"), total(F.greatest(F.col("l") - F.col("r"), F.lit(0)), "left_only"), total(F.greatest(F.col("r") - F.col("l"), F.lit(0)), "right_only"))
    return out.withColumn("same_multiset", (F.col("left_only") == 0) & (F.col("right_only") == 0))


def sequence(left: DataFrame, right: DataFrame, ordinal: str, *columns: str) -> DataFrame:
    """One row: differing positions (rows there on one side only included) and same_sequence."""
    row = F.struct(*columns)
    met = left.select(ordinal, row.alias("a")).join(right.select(ordinal, row.alias("b")), ordinal, "full_outer")
    out = met.agg(F.coalesce(F.sum((~F.col("a").eqNullSafe(F.col("b"))).cast("bigint")), F.lit(0)).alias("differing"))
    return out.withColumn("same_sequence", F.col("differing") == 0)


def ranges_disjoint(left: DataFrame, right: DataFrame, at: str) -> DataFrame:
    """One row: whether the datasets' closed time ranges share no instant; true where one is empty."""
    a, b = (df.agg(F.min(at).alias(f"{s}0"), F.max(at).alias(f"{s}1")) for df, s in ((left, "a"), (right, "b")))
    met = a.withColumn("k", F.lit(1)).join(b.withColumn("k", F.lit(1)), "k")
    return met.select(F.coalesce((F.col("a1") < F.col("b0")) | (F.col("b1") < F.col("a0")), F.lit(True)).alias("disjoint"))


def bar_periods(left: DataFrame, right: DataFrame, keys: tuple[str, ...], values: tuple[str, ...]) -> DataFrame:
    """keys and outcome (identical, conflicting, left_only, right_only) of every period of two bar datasets."""
    same = lambda: F.struct(*values)
    met = left.select(*keys, same().alias("a")).join(right.select(*keys, same().alias("b")), list(keys), "full_outer")
    outcome = F.when(F.col("b").isNull(), "left_only").when(F.col("a").isNull(), "right_only").when(F.col("a").eqNullSafe(F.col("b")), "identical").otherwise("conflicting")
    return met.select(*keys, outcome.alias("outcome"))


def ambiguous_keys(bars: DataFrame, *keys: str) -> DataFrame:
    return bars.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def require_unique(bars: DataFrame, *keys: str) -> DataFrame:
    found = ambiguous_keys(bars, *keys).take(1)
    if found:
        raise AmbiguousKey(f"two bars for one period: {found[0].asDict()}")
    return bars


def compare(left: DataFrame, right: DataFrame, kind: str, at: str, ordinal: str, columns: tuple[str, ...], left_identity: tuple[str, str], right_identity: tuple[str, str]) -> dict[str, object]:
    """All findings on two datasets of the same (record type, contract), as plain values."""
    if left_identity != right_identity:
        raise NotComparable(f"{left_identity} and {right_identity}")
    out = multiset(left, right, *columns).first().asDict() | sequence(left, right, ordinal, *columns).first().asDict() | ranges_disjoint(left, right, at).first().asDict()
    out["reordered_only"] = out["same_multiset"] and not out["same_sequence"]
    if kind == "bar":
        keys = ("start_us", "interval_us")
        periods = bar_periods(require_unique(left, *keys), require_unique(right, *keys), keys, tuple(c for c in columns if c not in keys))
        out |= {r.outcome: r["count"] for r in periods.groupBy("outcome").count().collect()}
    return out


