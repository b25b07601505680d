"""Orders of events and the checks on them, without a global window: rows are dealt by ranges and edges are stitched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..schemas import PRECEDENCE
from .cut import materialized


def precedence(record_type: Column) -> Column:
    out = F.when(F.lit(False), F.lit(None).cast("int"))
    for k, v in PRECEDENCE.items():
        out = out.when(record_type == k, v)
    return out


def event_order(events: DataFrame) -> DataFrame:
    """events (timestamp, record_type, source_index) in their total order."""
    return events.orderBy("timestamp", precedence(F.col("record_type")), "source_index")


def _ranged(df: DataFrame, *order: str) -> DataFrame:
    """df dealt by ranges, with the number of the range. Bounds are sampled anew by each reading of a plan, so one reading is kept."""
    return materialized(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()))


def numbered(df: DataFrame, *order: str, name: str = "position") -> DataFrame:
    """df with its 0-based position in the order. Ranges are numbered apart; a range's start comes from the sizes of those before, one row for each."""
    ranged = _ranged(df, *order)
    sizes = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.withColumn("__before", F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)))
    within = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    out = ranged.withColumn("__at", within).join(F.broadcast(before.select("__part", "__before")), "__part")
    return out.withColumn(name, F.coalesce("__before", F.lit(0)).cast("bigint") + F.col("__at") - 1).drop("__part", "__at", "__before")


def with_previous(df: DataFrame, value: str, order: str, *keys: str, name: str = "previous") -> DataFrame:
    """df with the value of the row before in `order`, null for the first. Rows that `order` doesn't tell apart go by their values, smallest
    first, so the result doesn't depend on how they are stored or dealt.

    Within a range the row before is at hand; the last row of each range is carried on by a window over the ranges, of which there are
    as many as shuffle partitions.
    """
    ranged = _ranged(df, *keys, order)
    edge = ranged.groupBy(*keys, "__part").agg(F.max_by(value, F.struct(order, value)).alias("__v"))
    by = Window.partitionBy(*keys).orderBy("__part") if keys else Window.orderBy("__part")
    edge = edge.withColumn("__edge", F.lag("__v").over(by)).select(*keys, "__part", "__edge")
    inner = Window.partitionBy(*keys, "__part").orderBy(order, value)
    out = ranged.withColumn("__own", F.lag(value).over(inner)).withColumn("__first", F.row_number().over(inner) == 1)
    out = out.join(edge, [*keys, "__part"])
    return out.withColumn(name, F.when(F.col("__first"), F.col("__edge")).otherwise(F.col("__own"))).drop("__part", "__own", "__first", "__edge")


def going_back(rows: DataFrame, at: str, order: str) -> DataFrame:
    """Rows whose instant lies before that of the row stored before them: a source must not go backwards."""
    return with_previous(rows, at, order).where(F.col("previous") > F.col(at))
