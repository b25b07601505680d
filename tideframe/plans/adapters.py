"""The driver's tables as market data, and as the raw texts that vendors would send. Each adapter has a SQL twin for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HOUR_US = 3_600_000_000
DAY_US = 24 * HOUR_US
CONTRACT = "CME:ES:H2024"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ordinal, at_us, symbol, price, price_fp, size, side of events."""
    price = F.col("value").cast("decimal(18,6)")
    return load(spark, sf_dir, "events").select(
        F.col("event_id").alias("ordinal"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us"),
        F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("symbol"),
        price.alias("price"),
        (price * F.lit(1_000_000)).cast("bigint").alias("price_fp"),
        (F.col("event_id") % 7 + 1).alias("size"),
        F.when(F.col("event_type") == "purchase", "buy").when(F.col("event_type") == "signup", "sell").otherwise("unknown").alias("side"),
    )


def coarse(rows: DataFrame) -> DataFrame:
    """Instants cut to the hour, so that many events are simultaneous."""
    return rows.withColumn("at_us", F.floor(F.col("at_us") / HOUR_US) * HOUR_US)


def sourced(rows: DataFrame, source: str, kind: str) -> DataFrame:
    return rows.select(F.lit(source).alias("source"), F.lit(kind).alias("record_type"), *rows.columns)


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trades(spark, sf_dir)
    return t.select("ordinal", "at_us", "symbol", F.col("price_fp").alias("bid_fp"), (F.col("price_fp") + 250_000).alias("ask_fp"), (F.col("ordinal") % 5 + 1).alias("bid_size"), (F.col("ordinal") % 3 + 1).alias("ask_size"))


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ordinal, symbol, start_us, interval_us, at_us, fixed-point open, high, low, close, volume of lineitem; periods collide, as in conflicting files."""
    c = F.col
    fp = lambda x: (x.cast("decimal(18,6)") * F.lit(1_000_000)).cast("bigint")
    base = fp(c("l_extendedprice"))
    start = F.unix_micros(c("l_shipdate").cast("timestamp"))
    return load(spark, sf_dir, "lineitem").select(
        (c("l_orderkey") * 100 + c("l_linenumber")).alias("ordinal"),
        F.concat(F.lit("P"), (c("l_partkey") % 50).cast("string")).alias("symbol"),
        start.alias("start_us"),
        F.lit(DAY_US).cast("bigint").alias("interval_us"),
        (start + DAY_US).alias("at_us"),
        base.alias("open"),
        (base + fp(c("l_tax")) + 1_000_000).alias("high"),
        (base - fp(c("l_discount")) - 1).alias("low"),
        base.alias("close"),
        c("l_quantity").cast("bigint").alias("volume"),
    )


# The same adapters for the oracle.
T = """t AS (SELECT event_id AS ordinal, epoch_us(ts) AS at_us, 'U' || user_id AS symbol, CAST(CAST(value AS DECIMAL(18,6)) * 1000000 AS BIGINT) AS price_fp,
 event_id % 7 + 1 AS size, CASE event_type WHEN 'purchase' THEN 'buy' WHEN 'signup' THEN 'sell' ELSE 'unknown' END AS side FROM events)"""
TC = T + f", tc AS (SELECT * REPLACE (at_us // {HOUR_US} * {HOUR_US} AS at_us) FROM t)"
Q = T + ", q AS (SELECT ordinal, at_us, symbol, price_fp AS bid_fp, price_fp + 250000 AS ask_fp, ordinal % 5 + 1 AS bid_size, ordinal % 3 + 1 AS ask_size FROM t)"
B = f"""b AS (SELECT l_orderkey * 100 + l_linenumber AS ordinal, 'P' || (l_partkey % 50) AS symbol, epoch_us(l_shipdate) AS start_us, CAST({DAY_US} AS BIGINT) AS interval_us, epoch_us(l_shipdate) + {DAY_US} AS at_us,
 CAST(CAST(l_extendedprice AS DECIMAL(18,6)) * 1000000 AS BIGINT) AS open, CAST(CAST(l_extendedprice AS DECIMAL(18,6)) * 1000000 AS BIGINT) + CAST(CAST(l_tax AS DECIMAL(18,6)) * 1000000 AS BIGINT) + 1000000 AS high,
 CAST(CAST(l_extendedprice AS DECIMAL(18,6)) * 1000000 AS BIGINT) - CAST(CAST(l_discount AS DECIMAL(18,6)) * 1000000 AS BIGINT) - 1 AS low, CAST(CAST(l_extendedprice AS DECIMAL(18,6)) * 1000000 AS BIGINT) AS close, CAST(l_quantity AS BIGINT) AS volume FROM lineitem)"""

# Raw texts with planted defects, in SQL that both engines read; {iso} and {src} differ.
RAW_TRADE = """SELECT event_id AS source_index,
 CASE WHEN event_id % 97 = 1 THEN NULL WHEN event_id % 89 = 1 THEN 'yesterday' WHEN event_id % 83 = 1 THEN {iso} WHEN event_id % 79 = 1 THEN concat({iso}, '+01:00') WHEN event_id % 23 = 1 THEN concat({iso}, 'Z') ELSE concat({iso}, '+00:00') END AS timestamp,
 CASE WHEN event_id % 73 = 1 THEN NULL WHEN event_id % 71 = 1 THEN '  ' ELSE concat('U', CAST(user_id AS VARCHAR(20))) END AS instrument_symbol,
 CASE WHEN event_id % 67 = 1 THEN 'NaN' WHEN event_id % 61 = 1 THEN '-5.25' WHEN event_id % 59 = 1 THEN '0.00' WHEN event_id % 53 = 1 THEN '1000000000000' WHEN event_id % 47 = 1 THEN '5102.7500001' WHEN event_id % 43 = 1 THEN 'abc' WHEN event_id % 41 = 1 THEN '5102.7500000000' ELSE CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR(20)) END AS price,
 CASE WHEN event_id % 37 = 1 THEN '1.5' WHEN event_id % 31 = 1 THEN '18446744073709551616' WHEN event_id % 29 = 1 THEN '0' ELSE CAST(event_id % 7 + 1 AS VARCHAR(20)) END AS size,
 CASE event_type WHEN 'purchase' THEN ' BUY ' WHEN 'signup' THEN 'sell' WHEN 'error' THEN 'cross' ELSE 'Unknown' END AS side
 FROM {src}"""
RAW_QUOTE = """SELECT event_id AS source_index, concat({iso_day}, '+00:00') AS timestamp, concat('U', CAST(user_id % 20 AS VARCHAR(20))) AS instrument_symbol,
 CAST(CAST(value % 5 AS DECIMAL(18,0)) + CASE WHEN event_id % 11 = 1 THEN 3 ELSE 1 END AS VARCHAR(20)) AS bid, concat(CAST(CAST(value % 5 AS DECIMAL(18,0)) + 2 AS VARCHAR(20)), CASE WHEN event_id % 2 = 0 THEN '.0' ELSE '' END) AS ask,
 '1' AS bid_size, CAST(event_id % 2 + 1 AS VARCHAR(20)) AS ask_size FROM {src}"""
RAW_BAR = """SELECT l_orderkey * 100 + l_linenumber AS source_index, concat({iso_ship}, '+00:00') AS timestamp, concat('P', CAST(l_partkey % 50 AS VARCHAR(20))) AS instrument_symbol,
 CASE WHEN l_orderkey % 101 = 1 THEN '-60' WHEN l_orderkey % 103 = 1 THEN 'day' WHEN l_orderkey % 107 = 1 THEN '0.0000001' WHEN l_linenumber % 2 = 0 THEN '86400' ELSE '86400.0' END AS interval,
 CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR(20)) AS open, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) + CASE WHEN l_orderkey % 109 = 1 THEN -1 ELSE 1 END AS VARCHAR(20)) AS high,
 CAST(CAST(l_extendedprice AS DECIMAL(18,2)) - 1 AS VARCHAR(20)) AS low, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR(20)) AS close, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR(20)) AS volume FROM {src}"""


def _spark_sql(spark: SparkSession, sql: str, **tables: DataFrame) -> DataFrame:
    iso = "date_format({c}, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS\")"
    text = sql.replace("{iso_day}", iso.replace("{c}", "date_trunc('DAY', ts)")).replace("{iso_ship}", iso.replace("{c}", "l_shipdate")).replace("{iso}", iso.replace("{c}", "ts"))
    return spark.sql(text, **tables)


def duck(sql: str, table: str) -> str:
    iso = "strftime({c}, '%Y-%m-%dT%H:%M:%S.%f')"
    return sql.replace("{iso_day}", iso.replace("{c}", "date_trunc('day', ts)")).replace("{iso_ship}", iso.replace("{c}", "l_shipdate")).replace("{iso}", iso.replace("{c}", "ts")).replace("{src}", table)


def raw_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spark_sql(spark, RAW_TRADE, src=load(spark, sf_dir, "events"))


def raw_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spark_sql(spark, RAW_QUOTE, src=load(spark, sf_dir, "events"))


def raw_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spark_sql(spark, RAW_BAR, src=load(spark, sf_dir, "lineitem"))


RT, RQ, RB = (f"r AS ({duck(s, t)})" for s, t in ((RAW_TRADE, "events"), (RAW_QUOTE, "events"), (RAW_BAR, "lineitem")))
