"""A profile of a delimited export: what each column holds, which schemas it could serve, and what is worth a look."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .delimited import read_delimited
from .feeds import whole

EXAMPLES = 12
MAX_ROWS = 1000
EXPECTED = {"trade": ("date", "ms_of_day", "price", "size"), "quote": ("date", "ms_of_day", "bid", "ask", "bid_size", "ask_size"), "ohlc": ("date", "ms_of_day", "open", "high", "low", "close", "volume")}


def column_profile(df: DataFrame, columns: list[str], index: str = "source_index", max_rows: int | None = MAX_ROWS) -> DataFrame:
    """name, seen, empty, integers, decimals, texts, zeros, min_int, max_int, max_places, dates, examples of each column.

    One aggregate over (column, value) rows of the first max_rows rows; a value's first place decides the order of examples.
    """
    rows = df if max_rows is None else df.where(F.col(index) < max_rows)
    pairs = rows.select(F.col(index).alias("i"), F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"`{c}`").alias("v")) for c in columns])).alias("p")).select("i", "p.name", "p.v")
    t = F.btrim(F.coalesce("v", F.lit("")))
    number = whole(t)
    decimal = t.rlike(r"^[+-]?([0-9]+\.[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$|^[+-]?[0-9]+[eE][+-]?[0-9]+$")
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False))).cast("bigint")
    day = F.when(t.rlike("^[0-9]{8}$"), F.concat_ws("-", F.substring(t, 1, 4), F.substring(t, 5, 2), F.substring(t, 7, 2)).try_cast("date"))
    out = pairs.groupBy("name").agg(
        F.count(F.lit(1)).alias("seen"),
        n(t == "").alias("empty"),
        n(number.isNotNull()).alias("integers"),
        n(decimal).alias("decimals"),
        n((t != "") & number.isNull() & ~decimal).alias("texts"),
        n(t.rlike(r"^[+-]?0+(\.0*)?$")).alias("zeros"),
        F.min(number).cast("bigint").alias("min_int"),
        F.max(number).cast("bigint").alias("max_int"),
        F.max(F.when(decimal, F.length(F.regexp_extract(t, r"\.([0-9]*)", 1)))).alias("max_places"),
        n(day.isNotNull()).alias("dates"),
    )
    firsts = pairs.where(t != "").groupBy("name", t.alias("v")).agg(F.min("i").alias("i"))
    firsts = firsts.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("e"))
    examples = F.concat_ws("|", F.transform(F.slice("e", 1, EXAMPLES), lambda x: x["v"]))
    return out.join(firsts.select("name", examples.alias("examples")), "name", "left").withColumn("examples", F.coalesce("examples", F.lit("")))


def findings(profile: list, header: list[str]) -> list[str]:
    """Notes on the profile's rows."""
    out = []
    if header and header[0].startswith("﻿"):
        out.append("the header begins with a byte order mark")
    for c in sorted(profile, key=lambda r: header.index(r["name"])):
        filled = c["seen"] - c["empty"]
        if filled and c["dates"] == filled:
            out.append(f"{c['name']}: looks like YYYYMMDD")
        elif filled and c["integers"] == filled and "ms" in c["name"] and 0 <= c["min_int"] and c["max_int"] < 86_400_000:
            out.append(f"{c['name']}: lies within a day's milliseconds")
        if c["decimals"]:
            out.append(f"{c['name']}: decimal text, up to {c['max_places']} places")
        elif filled and c["integers"] == filled and c["name"] in ("price", "bid", "ask", "open", "high", "low", "close"):
            out.append(f"{c['name']}: whole numbers only; scaled, perhaps")
        for what in ("zeros", "empty", "texts"):
            if c[what]:
                out.append(f"{c['name']}: {c[what]} {what}")
    return out


def inspect(spark: SparkSession, path: str, encoding: str = "utf-8", max_rows: int | None = MAX_ROWS) -> dict:
    df = read_delimited(spark, path, encoding)
    header = [c for c in df.columns if c not in ("__file", "source_index")]
    rows = [r.asDict() for r in column_profile(df, header, max_rows=max_rows).collect()]
    return {"header": header, "columns": rows, "schemas": [s for s, need in EXPECTED.items() if set(need) <= set(header)], "findings": findings(rows, header)}


def report(found: dict) -> str:
    lines = [f"columns: {', '.join(found['header'])}", f"could be: {', '.join(found['schemas']) or 'none'}"]
    for c in sorted(found["columns"], key=lambda r: found["header"].index(r["name"])):
        lines.append(f"  {c['name']}: {c['seen']} seen, {c['empty']} empty, {c['integers']} integers, {c['decimals']} decimals, {c['texts']} texts; e.g. {c['examples']}")
    return "\n".join(lines + [f"note: {f}" for f in found["findings"]])


def main(argv: list[str] | None = None) -> int:
    paths = sys.argv[1:] if argv is None else argv
    if len(paths) != 1:
        print("usage: python -m tideframe.sources.profile FILE", file=sys.stderr)
        return 2
    spark = SparkSession.builder.master("local[2]").getOrCreate()
    print(report(inspect(spark, paths[0])))
    return 0


if __name__ == "__main__":
    sys.exit(main())
