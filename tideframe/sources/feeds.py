"""Two vendors' encodings, decoded by expressions: A has nanoseconds and 1e-9 fixed point, B local dates and milliseconds of the day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as E
from .delimited import Capability, NotConfigured, reconciled

# Fixed sentinels and codes.
UNDEFINED_PRICE = 2**63 - 1
UNDEFINED_TIME = 2**64 - 1
SIDES_A = {"A": "sell", "B": "buy", "N": "unknown"}
SCHEMAS_A = {"trades": "trade", "mbp-1": "quote", "ohlcv": "bar"}
SCHEMAS_B = {"trade": "trade", "quote": "quote", "ohlc": "bar"}


def whole(text: Column) -> Column:
    t = E.stripped(text)
    return F.when(t.rlike("^[+-]?[0-9]{1,20}$"), t.try_cast("decimal(20,0)"))


def nanos_to_micros(text: Column, truncate: bool = False) -> Column:
    """Microseconds since the epoch; null for no number, the undefined instant, and, unless truncated, a remainder below a microsecond."""
    n = whole(text)
    # Exact in decimals; instants before the epoch round towards the past.
    us = F.floor(n.cast("decimal(38,3)") * F.lit("0.001").cast("decimal(4,3)"))
    ok = (n != F.lit(str(UNDEFINED_TIME)).cast("decimal(20,0)")) & (F.lit(truncate) | (F.pmod(n, F.lit(1000).cast("decimal(20,0)")) == 0))
    return F.when(ok, us.try_cast("bigint"))


def fixed_point_price(text: Column) -> Column:
    """A 1e-9 integer as decimal(30,9); null for no number and the undefined price."""
    n = whole(text)
    return F.when(n != F.lit(str(UNDEFINED_PRICE)).cast("decimal(20,0)"), (n.try_cast("decimal(19,0)") * F.lit("0.000000001").cast("decimal(10,9)")).cast("decimal(30,9)"))


def count(text: Column) -> Column:
    return whole(text)


def aggressor(text: Column) -> Column:
    """buy, sell, unknown, or the text itself."""
    out, code = F.when(F.lit(False), text), F.upper(E.stripped(text))
    for k, v in SIDES_A.items():
        out = out.when(code == k, v)
    return out.otherwise(text)


def mapped_symbol(df: DataFrame, symbols: dict[int, str], configured: str | None = None) -> DataFrame:
    """df (instrument_id, symbol where the file has it) with instrument_symbol: the mapping's, which must agree with the file's own.

    The mapping is an argument; a row that neither names fails, as does an id that isn't a number.
    """
    table = F.create_map(*[x for k, v in symbols.items() for x in (F.lit(k).cast("bigint"), F.lit(v))]) if symbols else F.create_map().cast("map<bigint,string>")
    key = F.coalesce(whole(F.col("instrument_id")).cast("bigint"), F.raise_error(F.concat(F.lit("not an instrument id: "), F.coalesce("instrument_id", F.lit("null")))).cast("bigint"))
    given = F.coalesce(F.try_element_at(table, key), F.lit(configured))
    own = F.col("symbol") if "symbol" in df.columns else F.lit(None).cast("string")
    own = F.when(E.stripped(own) != "", own)
    met = F.when(own.isNotNull() & given.isNotNull() & (own != given), F.raise_error(F.concat(F.lit("two symbols: "), own, F.lit(", "), given)).cast("string")).otherwise(F.coalesce(given, own))
    return df.withColumn("instrument_symbol", F.coalesce(met, F.raise_error(F.concat(F.lit("no symbol for id "), key.cast("string"))).cast("string")))


def feed_a(raw: DataFrame, schema: str, symbols: dict[int, str], interval_us: int | None = None, timestamp: str | None = None, truncate: bool = False) -> DataFrame:
    """Decoded rows of feed A: source_index, at_us, instrument_symbol, and the record's fields; a bar is available at its vendor start plus its interval."""
    if schema not in SCHEMAS_A:
        raise Capability(f"no schema {schema}")
    kind = SCHEMAS_A[schema]
    if (interval_us is not None) != (kind == "bar"):
        raise NotConfigured("bars need an interval, and nothing else does")
    at = nanos_to_micros(F.col(timestamp or ("ts_event" if kind == "bar" else "ts_recv")), truncate)
    own = mapped_symbol(raw, symbols)
    cols = ["source_index", (at + F.lit(interval_us or 0)).alias("at_us"), "instrument_symbol"]
    if kind == "trade":
        cols += [fixed_point_price(F.col("price")).alias("price"), count(F.col("size")).alias("size"), aggressor(F.col("side")).alias("side")]
    elif kind == "quote":
        cols += [fixed_point_price(F.col(a)).alias(b) for a, b in (("bid_px_00", "bid"), ("ask_px_00", "ask"))] + [count(F.col(a)).alias(b) for a, b in (("bid_sz_00", "bid_size"), ("ask_sz_00", "ask_size"))]
    else:
        cols += [F.lit(interval_us).alias("interval_us")] + [fixed_point_price(F.col(c)).alias(c) for c in ("open", "high", "low", "close")] + [count(F.col("volume")).alias("volume")]
    return own.select(*cols)


def local_datetime(day: Column, ms: Column) -> Column:
    """timestamp_ntz of YYYYMMDD and milliseconds of the day, or null."""
    d, m = E.stripped(day), whole(ms)
    shaped = F.when(d.rlike("^[0-9]{8}$"), F.concat_ws("-", F.substring(d, 1, 4), F.substring(d, 5, 2), F.substring(d, 7, 2)).try_cast("date"))
    base = shaped.cast("timestamp_ntz")
    return F.when(m.between(0, 86_399_999), (F.timestamp_micros(F.unix_micros(base.cast("timestamp")) + m.cast("bigint") * 1000)).cast("timestamp_ntz"))


def session_instant(day: Column, ms: Column, zone: str) -> tuple[Column, Column]:
    """(microseconds or null, null or not_a_time, nonexistent, ambiguous)."""
    local = local_datetime(day, ms)
    at, why = E.local_to_utc(local, zone)
    return F.unix_micros(at), F.when(local.isNull(), "not_a_time").otherwise(why)


def feed_b(raw: DataFrame, schema: str, zone: str, symbol: str | None = None, interval_us: int | None = None, stamp: str | None = None, sides: dict[str, str] | None = None) -> DataFrame:
    """Decoded rows of feed B; for bars, stamp says whether the file's instant is the interval's start or its end."""
    if schema not in SCHEMAS_B:
        raise Capability(f"no schema {schema}")
    kind = SCHEMAS_B[schema]
    if kind == "bar" and (interval_us is None or stamp not in ("start", "end")) or kind != "bar" and interval_us is not None:
        raise NotConfigured("bars need an interval and what their stamp means, and nothing else does")
    at, why = session_instant(F.col("date"), F.col("ms_of_day"), zone)
    shift = interval_us if kind == "bar" and stamp == "start" else 0
    own = reconciled(F.col("symbol") if "symbol" in raw.columns else F.lit(None).cast("string"), symbol)
    cols = [F.col("source_index"), (at + F.lit(shift)).alias("at_us"), why.alias("time_problem"), own.alias("instrument_symbol")]
    number = lambda c: E.as_decimal(F.col(c)).alias(c)
    if kind == "trade":
        side = F.lit("unknown")
        if sides is not None and "side" in raw.columns:
            table = F.create_map(*[F.lit(x) for kv in sides.items() for x in kv])
            side = F.coalesce(F.try_element_at(table, E.stripped(F.col("side"))), F.col("side"))
        cols += [number("price"), number("size"), side.alias("side")]
    elif kind == "quote":
        cols += [number(c) for c in ("bid", "ask", "bid_size", "ask_size")]
    else:
        cols += [F.lit(interval_us).alias("interval_us")] + [number(c) for c in ("open", "high", "low", "close", "volume")]
    return raw.select(*cols)
