"""The registered queries of the market-data operators over the driver's tables, each with its oracle."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import encoding as N
from ..functions import exprs as E
from ..operators import calendar as C
from ..operators import catalog as G
from ..operators import compare as M
from ..operators import identity as I
from ..operators import lineage as L
from ..operators import ordering as O
from ..operators import replay as R
from ..operators import rollover as X
from ..operators import validate as V
from ..operators.cut import shared_folder
from ..sources import feeds, profile
from . import adapters as A

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


H = A.HOUR_US
JAN = 1704067200000000  # 2024-01-01T00:00Z

# --- replay ---------------------------------------------------------------------------------------------------------


def _one(spark, sf):
    return A.sourced(A.coarse(A.trades(spark, sf)), "s1", "trade")


@query(f"WITH {A.TC} SELECT at_us, count(*) AS n_events, min(ordinal) AS first_ordinal, max(ordinal) AS last_ordinal, CAST(sum(size) AS BIGINT) AS volume, CAST(sum(price_fp * size) AS BIGINT) AS notional_fp FROM tc GROUP BY at_us")
def replay_frames(spark, sf):
    return R.frame_summary(_one(spark, sf))


def _three(spark, sf):
    t = A.coarse(A.trades(spark, sf)).select("ordinal", "at_us", "symbol", "price_fp", "size")
    q = A.coarse(A.quotes(spark, sf)).select("ordinal", "at_us", "symbol", "bid_fp", "ask_fp")
    b = A.bars(spark, sf).select("ordinal", "at_us", "symbol", F.col("close").alias("close_fp"), "volume")
    return R.union_sources([A.sourced(q, "a", "quote"), A.sourced(t, "b", "trade"), A.sourced(b, "c", "bar")])


U = f"""{A.TC}, {A.Q[len(A.T) + 2:]}, {A.B}, u AS (
 SELECT 'a' AS source, 'quote' AS record_type, ordinal, at_us // {H} * {H} AS at_us, symbol, CAST(NULL AS BIGINT) AS price_fp, CAST(NULL AS BIGINT) AS size, bid_fp, ask_fp, CAST(NULL AS BIGINT) AS close_fp, CAST(NULL AS BIGINT) AS volume FROM q
 UNION ALL SELECT 'b', 'trade', ordinal, at_us, symbol, price_fp, size, NULL, NULL, NULL, NULL FROM tc
 UNION ALL SELECT 'c', 'bar', ordinal, at_us, symbol, NULL, NULL, NULL, NULL, close, volume FROM b)"""


@query(f"WITH {U} SELECT source, record_type, ordinal, at_us, symbol, price_fp, size, bid_fp, ask_fp, close_fp, volume FROM u")
def replay_multi_source(spark, sf):
    return _three(spark, sf)


@query(f"WITH {A.TC}, {A.Q[len(A.T) + 2:]}, u AS (SELECT 'a' AS source, ordinal, at_us // {H} * {H} AS at_us FROM q UNION ALL SELECT 'b', ordinal, at_us FROM tc) SELECT source, ordinal, at_us, row_number() OVER (PARTITION BY at_us ORDER BY source, ordinal) - 1 AS frame_position FROM u")
def replay_frame_events(spark, sf):
    t, q = A.coarse(A.trades(spark, sf)), A.coarse(A.quotes(spark, sf))
    both = R.union_sources([A.sourced(q.select("ordinal", "at_us"), "a", "quote"), A.sourced(t.select("ordinal", "at_us"), "b", "trade")])
    return R.positions(both).select("source", "ordinal", "at_us", "frame_position")


@query(f"WITH {A.TC}, {A.Q[len(A.T) + 2:]}, u AS (SELECT 'a' AS source, 'quote' AS k, ordinal, at_us // {H} * {H} AS at_us FROM q UNION ALL SELECT 'b', 'trade', ordinal, at_us FROM tc) SELECT at_us, string_agg(source || ':' || ordinal, ',' ORDER BY source, ordinal) AS events FROM u GROUP BY at_us")
def replay_frame_lists(spark, sf):
    t, q = A.coarse(A.trades(spark, sf)), A.coarse(A.quotes(spark, sf))
    both = R.union_sources([A.sourced(q.select("ordinal", "at_us"), "a", "quote"), A.sourced(t.select("ordinal", "at_us"), "b", "trade")])
    return R.frames(both).select("at_us", F.concat_ws(",", F.transform("events", lambda e: F.concat_ws(":", e["source"], e["ordinal"]))).alias("events"))


@query(f"WITH {A.T} SELECT ordinal, at_us, symbol, price_fp FROM t WHERE at_us >= {JAN + 7 * A.DAY_US} AND at_us < {JAN + 14 * A.DAY_US}")
def replay_range(spark, sf):
    return R.select_range(A.trades(spark, sf), JAN + 7 * A.DAY_US, JAN + 14 * A.DAY_US).select("ordinal", "at_us", "symbol", "price_fp")


@query(f"WITH {A.T}, s AS (SELECT symbol, size, min(at_us) AS lo, max(at_us) AS hi FROM t GROUP BY symbol, size) SELECT x.symbol || '/' || x.size AS a, y.symbol || '/' || y.size AS b FROM s x JOIN s y ON x.symbol = y.symbol AND x.symbol || '/' || x.size < y.symbol || '/' || y.size AND x.hi >= y.lo AND y.hi >= x.lo")
def replay_overlap_conflicts(spark, sf):
    t = A.trades(spark, sf).withColumn("source", F.concat_ws("/", "symbol", "size"))
    about = t.groupBy("source").agg(F.min("symbol").alias("contract")).withColumn("record_type", F.lit("trade"))
    return R.overlaps(R.spans(t).join(about, "source"))


@query(f"WITH {A.T}, m AS (SELECT 'm' || symbol AS source, sha256(CAST(min(size) * 1000 + max(size) AS VARCHAR)) AS semantic_hash FROM t GROUP BY symbol) SELECT semantic_hash, string_agg(source, ',' ORDER BY source) AS sources FROM m GROUP BY semantic_hash HAVING count(*) > 1")
def replay_duplicate_semantics(spark, sf):
    m = A.trades(spark, sf).groupBy("symbol").agg(F.min("size").alias("a"), F.max("size").alias("b"))
    m = m.select(F.concat(F.lit("m"), "symbol").alias("source"), F.sha2((F.col("a") * 1000 + F.col("b")).cast("string"), 256).alias("semantic_hash"))
    return R.duplicate_semantics(m).select("semantic_hash", F.concat_ws(",", "sources").alias("sources"))


@query(f"WITH {A.T}, s AS (SELECT symbol AS source, ordinal, at_us - ordinal % 3 * 100000000000 AS at_us FROM t), l AS (SELECT *, lag(at_us) OVER (PARTITION BY source ORDER BY ordinal) AS previous FROM s) SELECT source, ordinal, at_us, previous FROM l WHERE previous > at_us")
def monotonicity_violations(spark, sf):
    t = A.trades(spark, sf).select(F.col("symbol").alias("source"), "ordinal", (F.col("at_us") - F.col("ordinal") % 3 * 100_000_000_000).alias("at_us"))
    return R.steps_back(t).select("source", "ordinal", "at_us", "previous")


@query(f"WITH {A.T} SELECT symbol AS source, min(at_us) AS lo, max(at_us) AS hi FROM t GROUP BY symbol")
def replay_spans(spark, sf):
    return R.spans(A.trades(spark, sf).withColumnRenamed("symbol", "source"))


@query(f"WITH {A.TC}, x AS (SELECT 'b' AS source, ordinal, at_us FROM tc UNION ALL SELECT 'b', ordinal, at_us FROM tc WHERE ordinal % 10 = 0) SELECT source, ordinal, count(*) AS n FROM x GROUP BY at_us, source, ordinal HAVING count(*) > 1")
def replay_broken_invariants(spark, sf):
    t = A.sourced(A.coarse(A.trades(spark, sf)), "b", "trade")
    return R.broken_invariants(t.unionByName(t.where("ordinal % 10 = 0"))).select("source", "ordinal", "n")


@query(f"WITH {A.T}, tc AS (SELECT * REPLACE (at_us // {H} * {H} AS at_us) FROM t) SELECT at_us, count(*) AS n_events, min(ordinal) AS first_ordinal, max(ordinal) AS last_ordinal, CAST(sum(size) AS BIGINT) AS volume, CAST(sum(price_fp * size) AS BIGINT) AS notional_fp FROM tc GROUP BY at_us")
def replay_prepared(spark, sf):
    """Checks, then frames, of two sources that don't overlap."""
    t = A.trades(spark, sf)
    cut = JAN + 15 * A.DAY_US
    one, two = A.sourced(t.where(F.col("at_us") < cut), "x", "trade"), A.sourced(t.where(F.col("at_us") >= cut), "y", "trade")
    about = spark.createDataFrame([("x", "1", A.CONTRACT, "trade", 3), ("y", "2", A.CONTRACT, "trade", 3)], "source string, semantic_hash string, contract string, record_type string, schema_version int")
    return R.frame_summary(A.coarse(R.prepare([one, two], about)))


@query("WITH h AS (SELECT epoch_us(date_trunc('hour', ts)) AS at_us, event_id, event_id % 7 + 1 AS size FROM events) SELECT at_us, count(*) AS n_events, min(event_id) AS first_ordinal, max(event_id) AS last_ordinal, CAST(sum(size) AS BIGINT) AS volume FROM h GROUP BY at_us")
def stream_frames(spark, sf):
    """Frames of the events as a stream; instants are whole hours, so the watermark passes the last one, too."""
    from ..streaming import replay_stream as S

    events = spark.readStream.schema(A.load(spark, sf, "events").schema).parquet(f"{sf}/events.parquet" if _is_folder(spark, sf) else f"{sf}/events*.parquet")
    rows = events.select(F.date_trunc("HOUR", F.col("ts").cast("timestamp")).alias("timestamp"), F.lit("s").alias("source"), F.col("event_id").alias("ordinal"), (F.col("event_id") % 7 + 1).alias("size"))
    base = f"{shared_folder(spark)}/frames-{uuid.uuid4().hex}"
    out = S.run_to_table(S.frames(rows), f"{base}/table", f"{base}/checkpoint")
    return out.select(F.unix_micros("timestamp").alias("at_us"), "n_events", "first_ordinal", "last_ordinal", "volume")


def _is_folder(spark: SparkSession, sf: str) -> bool:
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{sf}/events.parquet")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()


# --- validation -----------------------------------------------------------------------------------------------------

STATUS = r"""CASE WHEN timestamp IS NULL OR try_cast(regexp_replace(timestamp, '(Z|[+-]\d\d:\d\d)$', '') AS TIMESTAMP) IS NULL THEN 'not_datetime' WHEN NOT regexp_matches(timestamp, '(Z|[+-]\d\d:\d\d)$') THEN 'naive' WHEN NOT regexp_matches(timestamp, '(Z|[+-]00:00)$') THEN 'non_utc' ELSE 'valid' END"""
MICROS = r"epoch_us(try_cast(regexp_replace(timestamp, '(Z|[+-]\d\d:\d\d)$', '') AS TIMESTAMP))"


def _price_sql(c: str) -> str:
    return f"""CASE WHEN {c} IS NULL THEN 'not_a_number' WHEN lower({c}) IN ('nan', 'inf', 'infinity') THEN 'non_finite' WHEN try_cast({c} AS DECIMAL(38,12)) IS NULL THEN 'not_a_number' WHEN try_cast({c} AS DECIMAL(38,12)) <= 0 THEN 'not_positive'
 WHEN try_cast({c} AS DECIMAL(38,12)) > 999999999999.999999 THEN 'magnitude_too_large' WHEN try_cast({c} AS DECIMAL(38,12)) <> CAST(CAST({c} AS DECIMAL(38,12)) AS DECIMAL(38,6)) THEN 'too_many_fractional_digits' END"""


def _quantity_sql(c: str) -> str:
    return f"""CASE WHEN {c} IS NULL THEN 'not_a_number' WHEN try_cast({c} AS DECIMAL(38,6)) IS NULL THEN 'not_a_number' WHEN CAST({c} AS DECIMAL(38,6)) <= 0 THEN 'not_positive' WHEN CAST({c} AS DECIMAL(38,6)) > 18446744073709551615 THEN 'magnitude_too_large' WHEN CAST({c} AS DECIMAL(38,6)) <> floor(CAST({c} AS DECIMAL(38,6))) THEN 'not_whole' END"""


def _coded_sql(c: str, codes: dict[str, str]) -> str:
    return "CASE " + c + " " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in codes.items()) + " END"


PRICE_CODE, SIZE_CODE = _coded_sql(f"({_price_sql('price')})", E.PRICE_CODES), _coded_sql(f"({_quantity_sql('size')})", E.QUANTITY_CODES)
TRADE_DEFECT = f"coalesce({PRICE_CODE}, {SIZE_CODE}, CASE WHEN lower(trim(side)) NOT IN ('buy', 'sell', 'unknown') THEN 'invalid_trade_side' END)"
TRADE_FIELD = f"CASE WHEN {PRICE_CODE} IS NOT NULL THEN 'price' WHEN {SIZE_CODE} IS NOT NULL THEN 'size' ELSE 'side' END"
WHOLE = "timestamp IS NOT NULL AND instrument_symbol IS NOT NULL"
ISSUES_SQL = f"""i AS (
 SELECT 0 AS validator, source_index AS row_index, 'ERROR' AS severity, 'missing_required_field' AS code, CASE WHEN timestamp IS NULL THEN 'timestamp' ELSE 'instrument_symbol' END AS field_name FROM r WHERE NOT ({WHOLE})
 UNION ALL SELECT 1, source_index, 'ERROR', CASE {STATUS} WHEN 'not_datetime' THEN 'non_datetime_timestamp' WHEN 'naive' THEN 'naive_datetime' ELSE 'non_utc_timestamp' END, 'timestamp' FROM r WHERE timestamp IS NOT NULL AND {STATUS} <> 'valid'
 UNION ALL SELECT 2, source_index, 'ERROR', 'invalid_instrument_symbol', 'instrument_symbol' FROM r WHERE trim(instrument_symbol) = ''
 UNION ALL SELECT 3, source_index, 'ERROR', {TRADE_DEFECT}, {TRADE_FIELD} FROM r WHERE {WHOLE} AND {TRADE_DEFECT} IS NOT NULL)"""


@query(f"WITH {A.RT}, {ISSUES_SQL} SELECT * FROM i WHERE validator = 0")
def validate_schema_issues(spark, sf):
    return V.schema_issues(A.raw_trades(spark, sf), "trade")


@query(f"WITH {A.RT}, {ISSUES_SQL} SELECT * FROM i WHERE validator = 1")
def validate_timestamp_issues(spark, sf):
    return V.timestamp_issues(A.raw_trades(spark, sf))


@query(f"WITH {A.RT}, {ISSUES_SQL} SELECT * FROM i WHERE validator = 2")
def validate_symbol_issues(spark, sf):
    return V.symbol_issues(A.raw_trades(spark, sf))


@query(f"WITH {A.RT}, {ISSUES_SQL} SELECT * FROM i WHERE validator = 3")
def validate_value_issues(spark, sf):
    return V.value_issues(A.raw_trades(spark, sf), "trade")


BAR_US = "CASE WHEN regexp_matches(interval, '^-?[0-9.]+$') AND CAST(CAST(interval AS DECIMAL(38,12)) * 1000000 AS DECIMAL(38,6)) = floor(CAST(interval AS DECIMAL(38,12)) * 1000000) THEN CAST(CAST(interval AS DECIMAL(38,12)) * 1000000 AS BIGINT) END"
BAR_DEFECT = f"CASE WHEN ({BAR_US}) IS NULL OR ({BAR_US}) <= 0 THEN 'invalid_bar_interval' WHEN CAST(high AS DECIMAL(18,6)) < CAST(low AS DECIMAL(18,6)) OR CAST(open AS DECIMAL(18,6)) NOT BETWEEN CAST(low AS DECIMAL(18,6)) AND CAST(high AS DECIMAL(18,6)) OR CAST(close AS DECIMAL(18,6)) NOT BETWEEN CAST(low AS DECIMAL(18,6)) AND CAST(high AS DECIMAL(18,6)) THEN 'invalid_ohlc' END"


@query(f"WITH {A.RB} SELECT 3 AS validator, source_index AS row_index, 'ERROR' AS severity, {BAR_DEFECT} AS code, CASE {BAR_DEFECT} WHEN 'invalid_ohlc' THEN 'high' ELSE 'interval' END AS field_name FROM r WHERE {BAR_DEFECT} IS NOT NULL")
def validate_bar_issues(spark, sf):
    return V.value_issues(A.raw_bars(spark, sf), "bar")


@query(f"WITH {A.RQ} SELECT 3 AS validator, source_index AS row_index, 'ERROR' AS severity, 'bid_ask_inversion' AS code, 'bid' AS field_name FROM r WHERE CAST(bid AS DECIMAL(18,6)) > CAST(ask AS DECIMAL(18,6))")
def validate_quote_issues(spark, sf):
    return V.value_issues(A.raw_quotes(spark, sf), "quote")


@query(f"""WITH {A.RT}, v AS (SELECT (source_index * 7919) % 1000003 AS source_index, {MICROS} // 3600000000 * 3600000000 AS tm FROM r WHERE {STATUS} = 'valid'), l AS (SELECT *, lag(tm) OVER (ORDER BY source_index) AS p FROM v)
 SELECT 5 AS validator, source_index AS row_index, CASE WHEN tm < p THEN 'ERROR' ELSE 'INFO' END AS severity, CASE WHEN tm < p THEN 'descending_timestamp' ELSE 'ambiguous_timestamp_order' END AS code, 'timestamp' AS field_name FROM l WHERE tm <= p""")
def validate_ordering_issues(spark, sf):
    raw = A.raw_trades(spark, sf).withColumn("source_index", F.col("source_index") * 7919 % 1000003)
    hour = F.regexp_replace("timestamp", r"T(\d\d):\d\d:\d\d\.\d+", "T$1:00:00.000000")
    return V.ordering_issues(raw.withColumn("timestamp", hour))


QUOTE_ID = f"{MICROS} AS tm, instrument_symbol AS s, CAST(bid AS DECIMAL(18,6)) AS b, CAST(ask AS DECIMAL(18,6)) AS a, bid_size AS x, ask_size AS y"


@query(f"WITH {A.RQ}, k AS (SELECT source_index, {QUOTE_ID} FROM r), d AS (SELECT source_index, min(source_index) OVER (PARTITION BY tm, s, b, a, x, y) AS f FROM k) SELECT 4 AS validator, source_index AS row_index, 'WARNING' AS severity, 'duplicate_row' AS code, CAST(NULL AS VARCHAR) AS field_name FROM d WHERE source_index > f")
def duplicate_rows(spark, sf):
    return V.duplicate_issues(A.raw_quotes(spark, sf), "quote")


BAR_ID = "CASE WHEN regexp_matches(interval, '^-?[0-9.]+$') THEN CAST(CAST(interval AS DECIMAL(38,12)) AS VARCHAR) ELSE interval END"
BAR_GROUPS = f"k AS (SELECT *, {BAR_ID} AS iv FROM r), g AS (SELECT instrument_symbol, timestamp, iv, count(*) AS n, min(source_index) AS f, " + ", ".join(f"min(CAST({c} AS DECIMAL(18,6))) <> max(CAST({c} AS DECIMAL(18,6))) AS d_{c}" for c in ("open", "high", "low", "close", "volume")) + " FROM k GROUP BY ALL HAVING count(*) > 1), m AS (SELECT k.source_index, g.* FROM k JOIN g USING (instrument_symbol, timestamp, iv))"
DIFFERING = "CASE " + " ".join(f"WHEN d_{c} THEN '{c}'" for c in ("open", "high", "low", "close", "volume")) + " END"


@query(f"WITH {A.RB}, {BAR_GROUPS} SELECT 4 AS validator, source_index AS row_index, CASE WHEN {DIFFERING} IS NULL THEN 'WARNING' ELSE 'ERROR' END AS severity, CASE WHEN {DIFFERING} IS NULL THEN 'duplicate_row' ELSE 'conflicting_bar' END AS code, {DIFFERING} AS field_name FROM m WHERE {DIFFERING} IS NOT NULL OR source_index > f")
def conflicting_bars(spark, sf):
    return V.duplicate_issues(A.raw_bars(spark, sf), "bar")


def _dedup(keep: str) -> str:
    return f"WITH {A.RQ}, bad AS (SELECT source_index FROM r WHERE CAST(bid AS DECIMAL(18,6)) > CAST(ask AS DECIMAL(18,6))), k AS (SELECT source_index, {QUOTE_ID} FROM r WHERE source_index NOT IN (SELECT source_index FROM bad)) SELECT {keep}(source_index) AS source_index FROM k GROUP BY tm, s, b, a, x, y"


@query(_dedup("min"))
def dedup_reject(spark, sf):
    raw = A.raw_quotes(spark, sf)
    return V.survivors(raw, V.all_issues(raw, "quote"), "quote").select("source_index")


@query(_dedup("max"))
def dedup_keep_last(spark, sf):
    raw = A.raw_quotes(spark, sf)
    return V.survivors(raw, V.all_issues(raw, "quote"), "quote", "keep_last").select("source_index")


@query(f"WITH {A.RT}, {ISSUES_SQL} SELECT source_index, {MICROS} AS at_us, instrument_symbol, CAST(CAST(price AS DECIMAL(18,6)) * 1000000 AS BIGINT) AS price_fp, CAST(size AS BIGINT) AS size, lower(trim(side)) AS side FROM r WHERE source_index NOT IN (SELECT row_index FROM i)")
def import_accepted(spark, sf):
    rows, _ = V.import_batch(A.raw_trades(spark, sf), "trade")
    return rows.select("source_index", "at_us", "instrument_symbol", E.fixed_point(F.col("price")).alias("price_fp"), F.col("size").cast("bigint").alias("size"), "side")


@query(f"WITH {A.RT}, {ISSUES_SQL} SELECT (SELECT count(*) FROM r) AS total_rows, (SELECT count(*) FROM r WHERE source_index NOT IN (SELECT row_index FROM i)) AS accepted_rows, CAST(0 AS BIGINT) AS info, CAST(0 AS BIGINT) AS warning, count(*) AS error, CAST(0 AS BIGINT) AS fatal, count(*) = 0 AS success FROM i")
def import_report(spark, sf):
    raw = A.raw_trades(spark, sf)
    rows, issues = V.import_batch(raw, "trade")
    return V.report(issues, raw.count(), rows.count())


@query(f"WITH {A.RT}, {ISSUES_SQL} SELECT row_index, string_agg(code, ',' ORDER BY validator, code) AS codes, count(*) AS n FROM i GROUP BY row_index")
def issues_by_row(spark, sf):
    return V.by_row(V.all_issues(A.raw_trades(spark, sf), "trade"))


@query(f"WITH {U}, o AS (SELECT *, CASE record_type WHEN 'quote' THEN 0 WHEN 'trade' THEN 1 ELSE 2 END AS p FROM u WHERE source <> 'c') SELECT record_type, ordinal AS source_index, row_number() OVER (ORDER BY at_us, p, ordinal) - 1 AS position FROM o")
def event_order(spark, sf):
    u = _three(spark, sf).where("source <> 'c'").select("record_type", F.col("ordinal").alias("source_index"), "at_us")
    own = u.withColumn("p", O.precedence(F.col("record_type")))
    return O.numbered(own, "at_us", "p", "source_index").select("record_type", "source_index", "position")


# --- expressions ----------------------------------------------------------------------------------------------------


@query(f"WITH {A.RT} SELECT source_index, {_price_sql('price')} AS violation FROM r")
def price_envelope(spark, sf):
    return A.raw_trades(spark, sf).select("source_index", E.price_violation(F.col("price")).alias("violation"))


@query(f"WITH {A.RT} SELECT source_index, {_quantity_sql('size')} AS violation FROM r")
def quantity_envelope(spark, sf):
    return A.raw_trades(spark, sf).select("source_index", E.quantity_violation(F.col("size")).alias("violation"))


@query(f"WITH {A.T} SELECT ordinal, price_fp AS encoded, price_fp AS again, TRUE AS same FROM t")
def fixed_point_roundtrip(spark, sf):
    t = A.trades(spark, sf).withColumn("encoded", E.fixed_point(F.col("price")))
    back = E.from_fixed_point(F.col("encoded"))
    return t.select("ordinal", "encoded", E.fixed_point(back).alias("again"), (back == F.col("price")).alias("same"))


@query(f"WITH {A.RT} SELECT source_index, {STATUS} AS status, CASE WHEN {STATUS} = 'valid' THEN {MICROS} END AS at_us FROM r")
def timestamp_status(spark, sf):
    return A.raw_trades(spark, sf).select("source_index", E.timestamp_status(F.col("timestamp")).alias("status"), E.utc_micros(F.col("timestamp")).alias("at_us"))


@query(f"WITH {A.RT}, s AS (SELECT source_index, CASE WHEN lower(trim(side)) IN ('buy', 'sell', 'unknown') THEN lower(trim(side)) END AS side FROM r) SELECT source_index, side, coalesce(side <> 'unknown', FALSE) AS directional FROM s")
def side_parse(spark, sf):
    own = A.raw_trades(spark, sf).select("source_index", E.side(F.col("side")).alias("side"))
    return own.withColumn("directional", E.is_directional(F.col("side")))


NAMES = "SELECT event_id AS id, concat(CASE event_id % 4 WHEN 0 THEN 'CME' WHEN 1 THEN 'XCBT' WHEN 2 THEN '123' ELSE 'cme' END, ':', CASE event_id % 3 WHEN 0 THEN 'ES' WHEN 1 THEN '6E' ELSE 'TOOLONGROOTNAME' END, ':', substring('FGHJKMNQUVXZAB', CAST(event_id % 14 + 1 AS INT), 1), CAST(event_id % 12 * 100 + 1000 AS VARCHAR(10)), CASE WHEN event_id % 17 = 0 THEN ':X' ELSE '' END) AS name FROM {src}"


@query(f"WITH n AS ({A.duck(NAMES, 'events')}), p AS (SELECT id, name, string_split(name, ':') AS s FROM n), o AS (SELECT *, len(s) = 3 AND s[1] IN ('CME', 'XCBT') AND s[2] IN ('ES', '6E') AND regexp_matches(s[3], '^[FGHJKMNQUVXZ][1-9][0-9][0-9][0-9]$') AS ok FROM p) SELECT id, ok AS listed, CASE WHEN ok THEN s[1] END AS venue, CASE WHEN ok THEN s[2] END AS root, CASE WHEN ok THEN s[3][1] END AS month_code, CASE WHEN ok THEN CAST(strpos('FGHJKMNQUVXZ', s[3][1]) AS INT) END AS month, CASE WHEN ok THEN CAST(s[3][2:5] AS INT) END AS year FROM o")
def contract_id_parse(spark, sf):
    n = spark.sql(NAMES, src=A.load(spark, sf, "events"))
    return n.select("id", E.is_listed_contract(F.col("name")).alias("listed"), *[c.alias(k) for k, c in E.contract_parts(F.col("name")).items()])


@query("SELECT event_id AS id, CASE WHEN event_id % 111 < 10 THEN 2020 + event_id % 111 END AS one_digit, CASE WHEN event_id % 111 BETWEEN 10 AND 99 THEN 2000 + event_id % 111 END AS two_digits FROM events")
def contract_year_expand(spark, sf):
    code = (F.col("event_id") % 111).cast("string")
    return A.load(spark, sf, "events").select(F.col("event_id").alias("id"), F.when(F.length(code) == 1, E.full_year(code, 2020)).cast("bigint").alias("one_digit"), F.when(F.length(code) == 2, E.full_year(code, 2000)).cast("bigint").alias("two_digits"))


@query("SELECT event_id AS id, CASE WHEN event_id % 14 BETWEEN 1 AND 12 THEN substring('FGHJKMNQUVXZ', CAST(event_id % 14 AS INT), 1) END AS code, CASE WHEN event_id % 14 BETWEEN 1 AND 12 THEN CAST(event_id % 14 AS INT) END AS month FROM events")
def month_codes(spark, sf):
    own = A.load(spark, sf, "events").select(F.col("event_id").alias("id"), E.month_code((F.col("event_id") % 14).cast("int")).alias("code"))
    return own.withColumn("month", E.month_number(F.col("code")))


@query("WITH n AS (SELECT event_id AS id, 'CME:ES:' || CASE event_id % 3 WHEN 0 THEN 'CONTINUOUS' WHEN 1 THEN 'continuous' ELSE 'M2024' END || CASE event_id % 2 WHEN 0 THEN ':FRONT_' || user_id ELSE '' END AS name FROM events) SELECT id, regexp_matches(name, '^CME:ES:CONTINUOUS:FRONT_[0-9]+$') AS continuous, name = 'CME:ES:M2024' AS listed FROM n")
def continuous_id_parse(spark, sf):
    name = F.concat(F.lit("CME:ES:"), F.when(F.col("event_id") % 3 == 0, "CONTINUOUS").when(F.col("event_id") % 3 == 1, "continuous").otherwise("M2024"), F.when(F.col("event_id") % 2 == 0, F.concat(F.lit(":FRONT_"), F.col("user_id").cast("string"))).otherwise(""))
    own = A.load(spark, sf, "events").select(F.col("event_id").alias("id"), name.alias("name"))
    return own.select("id", E.is_continuous(F.col("name")).alias("continuous"), E.is_listed_contract(F.col("name")).alias("listed"))


@query(f"WITH {A.B} SELECT ordinal, start_us, start_us + interval_us AS available_us, at_us = start_us + interval_us AS same FROM b")
def bar_availability(spark, sf):
    at = F.col("start_us") + F.col("interval_us")
    return A.bars(spark, sf).select("ordinal", "start_us", at.alias("available_us"), (F.col("at_us") == at).alias("same"))


@query(f"WITH {A.B} SELECT ordinal, low <= high AND open BETWEEN low AND high AND close BETWEEN low AND high + 500000 AS consistent FROM b WHERE ordinal % 3 > 0 UNION ALL SELECT ordinal, FALSE FROM b WHERE ordinal % 3 = 0")
def ohlc_check(spark, sf):
    b = A.bars(spark, sf).withColumn("high", F.when(F.col("ordinal") % 3 == 0, F.col("low") - 1).otherwise(F.col("high")))
    return b.select("ordinal", E.ohlc_consistent(*[F.col(c) for c in ("open", "high", "low", "close")]).alias("consistent"))


@query(f"WITH {A.Q} SELECT ordinal, bid_fp <= ask_fp - ordinal % 4 * 100000 AS ordered FROM q")
def quote_check(spark, sf):
    return A.quotes(spark, sf).select("ordinal", (F.col("bid_fp") <= F.col("ask_fp") - F.col("ordinal") % 4 * 100_000).alias("ordered"))


# --- feeds ----------------------------------------------------------------------------------------------------------


@query(f"""WITH {A.T} SELECT ordinal AS source_index, CASE WHEN ordinal % 13 = 0 THEN NULL WHEN ordinal % 11 = 0 THEN NULL ELSE at_us END AS at_us, 'C' || ordinal % 5 AS instrument_symbol, CASE WHEN ordinal % 17 = 0 THEN NULL ELSE price_fp END AS price_fp, size, CASE ordinal % 4 WHEN 0 THEN 'sell' WHEN 1 THEN 'buy' WHEN 2 THEN 'unknown' ELSE 'X' END AS side FROM t""")
def feed_a_decode(spark, sf):
    t = A.trades(spark, sf)
    o = F.col("ordinal")
    ns = F.when(o % 13 == 0, str(feeds.UNDEFINED_TIME)).when(o % 11 == 0, (F.col("at_us") * 1000 + 1).cast("string")).otherwise((F.col("at_us") * 1000).cast("string"))
    raw = t.select(o.alias("source_index"), ns.alias("ts_recv"), (o % 5).cast("string").alias("instrument_id"), F.when(o % 17 == 0, str(feeds.UNDEFINED_PRICE)).otherwise((F.col("price_fp") * 1000).cast("string")).alias("price"), F.col("size").cast("string").alias("size"), F.substring(F.lit("AbNX"), (o % 4 + 1).cast("int"), F.lit(1)).alias("side"))
    out = feeds.feed_a(raw, "trades", {i: f"C{i}" for i in range(5)})
    return out.select("source_index", "at_us", "instrument_symbol", E.fixed_point(F.col("price")).alias("price_fp"), F.col("size").cast("bigint").alias("size"), "side")


@query(f"""WITH {A.T}, l AS (SELECT ordinal, price_fp, size, CASE WHEN ordinal % 19 = 0 THEN TIMESTAMP '2024-03-10 02:30:00' WHEN ordinal % 23 = 0 THEN TIMESTAMP '2024-11-03 01:30:00' ELSE make_timestamp(at_us // 1000 * 1000) END AS local FROM t)
 SELECT ordinal AS source_index, CASE WHEN ordinal % 19 = 0 OR ordinal % 23 = 0 THEN NULL ELSE epoch_us(local) + 6 * {H} END AS at_us, CASE WHEN ordinal % 19 = 0 THEN 'nonexistent' WHEN ordinal % 23 = 0 THEN 'ambiguous' END AS time_problem, price_fp, size FROM l""")
def feed_b_decode(spark, sf):
    t = A.trades(spark, sf)
    o = F.col("ordinal")
    ms = F.floor(F.col("at_us") / 1000)
    day = F.when(o % 19 == 0, "20240310").when(o % 23 == 0, "20241103").otherwise(F.date_format(F.timestamp_micros("at_us"), "yyyyMMdd"))
    of_day = F.when(o % 19 == 0, F.lit(9_000_000)).when(o % 23 == 0, F.lit(5_400_000)).otherwise(ms % 86_400_000)
    raw = t.select(o.alias("source_index"), day.alias("date"), of_day.cast("string").alias("ms_of_day"), F.col("price").cast("string").alias("price"), F.col("size").cast("string").alias("size"))
    out = feeds.feed_b(raw, "trade", "America/Chicago", symbol="ES")
    return out.select("source_index", "at_us", "time_problem", E.fixed_point(F.col("price")).alias("price_fp"), F.col("size").cast("bigint").alias("size"))


@query("SELECT event_id AS source_index, 'S' || user_id % 3 AS instrument_symbol FROM events")
def symbol_mapping(spark, sf):
    raw = A.load(spark, sf, "events").select(F.col("event_id").alias("source_index"), (F.col("user_id") % 3).cast("string").alias("instrument_id"))
    return feeds.mapped_symbol(raw, {0: "S0", 1: "S1", 2: "S2"}).select("source_index", "instrument_symbol")


@query(f"WITH {A.T}, o AS (SELECT DISTINCT symbol FROM t), m AS (SELECT 'U' || i AS symbol, CASE WHEN i % 2 = 0 THEN 'CME:ES:H2024' ELSE 'CME:NQ:H2024' END AS contract FROM range(100, 200) x(i)) SELECT coalesce(o.symbol, m.symbol) AS symbol, CASE WHEN contract IS NULL THEN 'unmapped' WHEN o.symbol IS NULL THEN 'unused' WHEN contract <> 'CME:ES:H2024' THEN 'divergent' ELSE 'mapped' END AS finding FROM o FULL JOIN m ON o.symbol = m.symbol")
def unmapped_symbols(spark, sf):
    m = spark.range(100, 200).select(F.concat(F.lit("U"), F.col("id").cast("string")).alias("symbol"), F.when(F.col("id") % 2 == 0, "CME:ES:H2024").otherwise("CME:NQ:H2024").alias("contract"))
    return G.mapping_findings(A.trades(spark, sf), m, "CME:ES:H2024")


PROFILED = ("price", "size")


@query("WITH " + A.RT + ", c AS (" + " UNION ALL ".join(f"SELECT '{c}' AS name, source_index, {c} AS v FROM r WHERE source_index < 1000" for c in PROFILED) + r""") SELECT name, count(*) AS seen, count(*) FILTER (WHERE coalesce(v, '') = '') AS empty, count(*) FILTER (WHERE regexp_matches(v, '^[+-]?[0-9]+$')) AS integers, count(*) FILTER (WHERE regexp_matches(v, '^[+-]?[0-9]+\.[0-9]*$')) AS decimals,
 count(*) FILTER (WHERE v <> '' AND NOT regexp_matches(v, '^[+-]?[0-9]+(\.[0-9]*)?$')) AS texts, count(*) FILTER (WHERE regexp_matches(v, '^[+-]?0+(\.0*)?$')) AS zeros, max(CASE WHEN regexp_matches(v, '^[+-]?[0-9]+\.[0-9]*$') THEN CAST(length(regexp_extract(v, '\.([0-9]*)', 1)) AS INT) END) AS max_places FROM c GROUP BY name""")
def column_profile(spark, sf):
    out = profile.column_profile(A.raw_trades(spark, sf), list(PROFILED))
    return out.select("name", "seen", "empty", "integers", "decimals", "texts", "zeros", "max_places")


# --- identity -------------------------------------------------------------------------------------------------------


def _be8(c: str) -> str:
    return f"lpad(to_hex(CAST({c} AS BIGINT)), 16, '0')"


TRADE_HEX = f"{_be8('at_us')} || {_be8('price_fp')} || {_be8('size')} || CASE side WHEN 'buy' THEN '00' WHEN 'sell' THEN '01' ELSE '02' END"


def _bytes(t: DataFrame):
    return N.record_bytes("trade", {"timestamp": F.col("at_us"), "price": F.col("price_fp"), "size": F.col("size"), "side": F.col("side")})


@query(f"WITH {A.T} SELECT ordinal, upper({TRADE_HEX}) AS bytes FROM t")
def record_bytes(spark, sf):
    t = A.trades(spark, sf)
    return t.select("ordinal", F.hex(_bytes(t)).alias("bytes"))


@query(f"WITH {A.T} SELECT sha256(unhex('{N.header('trade', A.CONTRACT).hex()}' || string_agg({TRADE_HEX}, '' ORDER BY ordinal) || {_be8('count(*)')})) AS semantic_hash, count(*) AS row_count FROM t")
def dataset_semantic_hash(spark, sf):
    t = A.trades(spark, sf)
    return N.semantic_hash(t.select("ordinal", _bytes(t).alias("raw")), "trade", A.CONTRACT)


@query(f"WITH {A.T} SELECT min(at_us) AS min_us, max(at_us) AS max_us FROM t")
def dataset_bounds(spark, sf):
    return I.bounds(A.trades(spark, sf))


@query(f"WITH {A.T} SELECT side, count(*) AS row_count, min(at_us) AS min_us, max(at_us) AS max_us, count(DISTINCT symbol) AS n_symbols, string_agg(DISTINCT symbol, ',' ORDER BY symbol) AS symbols FROM t GROUP BY side")
def dataset_manifest_stats(spark, sf):
    return I.facts(A.trades(spark, sf), "at_us", "symbol", "side")


# --- comparison -----------------------------------------------------------------------------------------------------


def _versions(spark, sf):
    t = A.trades(spark, sf).select("ordinal", "symbol", "price_fp", "size")
    left = t.where("ordinal % 10 <> 0")
    right = t.where("ordinal % 7 <> 0").withColumn("size", F.when(F.col("ordinal") % 21 == 1, F.col("size") + 1).otherwise(F.col("size")))
    return left, right


LR = f"{A.T}, l AS (SELECT ordinal, symbol, price_fp, size FROM t WHERE ordinal % 10 <> 0), r AS (SELECT ordinal, symbol, price_fp, CASE WHEN ordinal % 21 = 1 THEN size + 1 ELSE size END AS size FROM t WHERE ordinal % 7 <> 0)"


@query(f"WITH {LR}, o AS (SELECT symbol, price_fp, size FROM l INTERSECT ALL SELECT symbol, price_fp, size FROM r), x AS (SELECT symbol, price_fp, size FROM l EXCEPT ALL SELECT symbol, price_fp, size FROM r), y AS (SELECT symbol, price_fp, size FROM r EXCEPT ALL SELECT symbol, price_fp, size FROM l) SELECT (SELECT count(*) FROM l) AS left_rows, (SELECT count(*) FROM r) AS right_rows, (SELECT count(*) FROM o) AS overlap, (SELECT count(*) FROM x) AS left_only, (SELECT count(*) FROM y) AS right_only, FALSE AS same_multiset")
def compare_multiset(spark, sf):
    left, right = _versions(spark, sf)
    return M.multiset(left, right, "symbol", "price_fp", "size")


# Versions of each symbol's trades: the same, the other one, the same but for its order, and one of them later.
PAIRS = ("same", "other", "reordered", "later")


def _pair(spark, sf, name):
    left, right = _versions(spark, sf)
    if name == "other":
        return left, right
    if name == "reordered":
        return left, left.withColumn("ordinal", F.col("ordinal").bitwiseXOR(F.lit(1)))
    return left, left if name == "same" else left.withColumn("ordinal", F.col("ordinal") + 1_000_000_000)


PAIR_SQL = f"{LR}, p AS (SELECT 'same' AS pair, * FROM l UNION ALL SELECT 'other', * FROM r UNION ALL SELECT 'reordered', xor(ordinal, 1), symbol, price_fp, size FROM l UNION ALL SELECT 'later', ordinal + 1000000000, symbol, price_fp, size FROM l), k AS (SELECT unnest(['same', 'other', 'reordered', 'later']) AS pair), x AS (SELECT pair, l.* FROM l CROSS JOIN k)"


@query(f"WITH {PAIR_SQL}, d AS (SELECT coalesce(x.pair, p.pair) AS pair, count(*) FILTER (WHERE x.ordinal IS NULL OR p.ordinal IS NULL OR (x.symbol, x.price_fp, x.size) IS DISTINCT FROM (p.symbol, p.price_fp, p.size)) AS differing FROM x FULL JOIN p ON x.pair = p.pair AND x.ordinal = p.ordinal GROUP BY ALL) SELECT pair, differing, differing = 0 AS same_sequence FROM d")
def compare_sequence(spark, sf):
    out = [M.sequence(*_pair(spark, sf, p), "ordinal", "symbol", "price_fp", "size").select(F.lit(p).alias("pair"), "*") for p in PAIRS]
    return R.union_sources(out)


@query(f"WITH {A.B}, u AS (SELECT symbol, start_us, interval_us, min(open) AS open, max(volume) AS volume FROM b GROUP BY ALL), l AS (SELECT * FROM u WHERE start_us // {A.DAY_US} % 5 <> 0), r AS (SELECT symbol, start_us, interval_us, open, CASE WHEN start_us // {A.DAY_US} % 3 = 0 THEN volume + 1 ELSE volume END AS volume FROM u WHERE start_us // {A.DAY_US} % 7 <> 0) SELECT coalesce(l.symbol, r.symbol) AS symbol, coalesce(l.start_us, r.start_us) AS start_us, coalesce(l.interval_us, r.interval_us) AS interval_us, CASE WHEN r.symbol IS NULL THEN 'left_only' WHEN l.symbol IS NULL THEN 'right_only' WHEN l.open = r.open AND l.volume = r.volume THEN 'identical' ELSE 'conflicting' END AS outcome FROM l FULL JOIN r ON l.symbol = r.symbol AND l.start_us = r.start_us AND l.interval_us = r.interval_us")
def compare_bars(spark, sf):
    day = F.floor(F.col("start_us") / A.DAY_US)
    u = A.bars(spark, sf).groupBy("symbol", "start_us", "interval_us").agg(F.min("open").alias("open"), F.max("volume").alias("volume"))
    left, right = u.where(day % 5 != 0), u.where(day % 7 != 0).withColumn("volume", F.when(day % 3 == 0, F.col("volume") + 1).otherwise(F.col("volume")))
    return M.bar_periods(left, right, ("symbol", "start_us", "interval_us"), ("open", "volume"))


@query(f"WITH {A.B} SELECT symbol, start_us, count(*) AS n FROM b GROUP BY symbol, start_us HAVING count(*) > 1")
def ambiguous_bar_keys(spark, sf):
    return M.ambiguous_keys(A.bars(spark, sf), "symbol", "start_us")


@query(f"WITH {PAIR_SQL}, a AS (SELECT pair, min(ordinal) AS a0, max(ordinal) AS a1 FROM x GROUP BY pair), b AS (SELECT pair, min(ordinal) AS b0, max(ordinal) AS b1 FROM p GROUP BY pair) SELECT pair, a1 < b0 OR b1 < a0 AS disjoint FROM a JOIN b USING (pair)")
def compare_ranges(spark, sf):
    out = [M.ranges_disjoint(*_pair(spark, sf, p), "ordinal").select(F.lit(p).alias("pair"), "*") for p in PAIRS]
    return R.union_sources(out)


# --- calendar and rolls ---------------------------------------------------------------------------------------------

# The packaged weekly rules over January 2024, when Chicago is six hours behind UTC all month.
WINDOWS_SQL = f"""d AS (SELECT CAST(x AS DATE) AS trading_date, isodow(x) - 1 AS wd FROM generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-31', INTERVAL 1 DAY) g(x) WHERE isodow(x) <= 5),
 w0 AS (SELECT trading_date, wd, i, state, epoch_us(CAST(trading_date AS TIMESTAMP)) + 6 * {H} + CAST(a AS BIGINT) * 60000000 AS start_us, epoch_us(CAST(trading_date AS TIMESTAMP)) + 6 * {H} + CAST(b AS BIGINT) * 60000000 AS end_us FROM d, (VALUES (0, 'halt', -435, -420), (1, 'trading', -420, 915), (2, 'halt', 915, 930), (3, 'trading', 930, 960)) v(i, state, a, b)),
 w AS (SELECT CASE WHEN wd = 0 AND i = 0 THEN start_us - 2700000000 ELSE start_us END AS start_us, end_us, state, trading_date, 'weekly.' || ['monday', 'tuesday', 'wednesday', 'thursday', 'friday'][wd + 1] || '.' || i AS rule_key FROM w0)"""


def _january() -> C.Definition:
    from dataclasses import replace
    from datetime import date

    return replace(C.packaged(), first=date(2024, 1, 1), last=date(2024, 1, 31), exceptions=[], windows=[])


def _windows(spark):
    return C.materialize(spark, _january())


@query(f"WITH {WINDOWS_SQL} SELECT start_us, end_us, state, trading_date, rule_key FROM w")
def calendar_windows(spark, sf):
    return _windows(spark)


GAPS_SQL = "n AS (SELECT *, lead(start_us) OVER (ORDER BY start_us) AS nx FROM w), iv AS (SELECT start_us, end_us, state, trading_date, rule_key FROM w UNION ALL SELECT end_us, nx, 'closed', NULL, NULL FROM n WHERE nx > end_us)"


@query(f"WITH {A.T}, {WINDOWS_SQL}, {GAPS_SQL} SELECT ordinal, at_us, state, trading_date, rule_key, iv.start_us AS window_start, iv.end_us AS window_end, CASE WHEN iv.end_us < (SELECT max(end_us) FROM w) THEN iv.end_us END AS next_us FROM t LEFT JOIN iv ON at_us >= iv.start_us AND at_us < iv.end_us")
def calendar_resolve(spark, sf):
    return C.resolve(A.trades(spark, sf).select("ordinal", "at_us"), _windows(spark)).select("ordinal", "at_us", "state", "trading_date", "rule_key", "window_start", "window_end", "next_us")


@query(f"WITH {A.T}, {WINDOWS_SQL}, {GAPS_SQL} SELECT coalesce(state, 'outside') AS state, count(*) AS n, CAST(sum(size) AS BIGINT) AS volume FROM t LEFT JOIN iv ON at_us >= iv.start_us AND at_us < iv.end_us GROUP BY ALL")
def calendar_volume_by_state(spark, sf):
    met = C.resolve(A.trades(spark, sf).select("at_us", "size"), _windows(spark))
    return met.groupBy(F.coalesce("state", F.lit("outside")).alias("state")).agg(F.count(F.lit(1)).alias("n"), F.sum("size").cast("bigint").alias("volume"))


@query(f"WITH {WINDOWS_SQL} SELECT trading_date, start_us, end_us, state, rule_key FROM w WHERE trading_date IN (DATE '2024-01-15', DATE '2024-01-19')")
def calendar_windows_for(spark, sf):
    dates = spark.sql("SELECT explode(array(DATE '2024-01-15', DATE '2024-01-19', DATE '2024-01-20')) AS trading_date")
    return C.windows_for(_windows(spark), dates, _january()).select("trading_date", "start_us", "end_us", "state", "rule_key")


@query(f"WITH {WINDOWS_SQL}, {GAPS_SQL} SELECT start_us, end_us, state, CASE WHEN end_us < (SELECT max(end_us) FROM w) THEN end_us END AS next_us FROM iv")
def calendar_next_transition(spark, sf):
    return C.intervals(_windows(spark)).select("start_us", "end_us", "state", "next_us")


@query(f"WITH {WINDOWS_SQL} SELECT min(start_us) AS start_us, max(end_us) AS end_us FROM w")
def calendar_coverage(spark, sf):
    return C.supports(_windows(spark))


@query(f"WITH {WINDOWS_SQL}, p AS (SELECT DISTINCT rule_key FROM w) SELECT rule_key, CASE WHEN rule_key LIKE '%.0' THEN 'corroborated' ELSE 'verified-primary' END AS status FROM p")
def calendar_provenance(spark, sf):
    return C.provenance(spark, C.packaged()).join(_windows(spark).select("rule_key").distinct(), "rule_key", "left_semi").select("rule_key", "status")


DATES_SQL = "td AS (SELECT trading_date, min(start_us) AS first_us, min(start_us) FILTER (WHERE state = 'trading') AS trading_us, row_number() OVER (ORDER BY trading_date) AS rank FROM w GROUP BY trading_date)"


@query(f"WITH {WINDOWS_SQL}, {DATES_SQL} SELECT x.trading_date AS last_trade_date, y.trading_date AS target_date, y.trading_us AS effective_us FROM td x LEFT JOIN td y ON y.rank = x.rank - 3")
def trading_date_offset(spark, sf):
    w = _windows(spark)
    lives = w.select(F.col("trading_date").alias("last_trade_date")).distinct().withColumn("contract", F.lit(A.CONTRACT))
    return X.roll_targets(w, lives, 3, "first-trading-window-start").select("last_trade_date", "target_date", "effective_us")


@query(f"WITH {WINDOWS_SQL}, {DATES_SQL} SELECT trading_date, first_us, trading_us FROM td")
def roll_effective(spark, sf):
    return X.trading_dates(_windows(spark)).select("trading_date", "first_us", "trading_us")


ROLLS = [("CME:ES:U2023", "2024-01-05"), ("CME:ES:Z2023", "2024-01-19"), ("CME:ES:H2024", "2024-01-31")]
RANGE = (JAN, JAN + 30 * A.DAY_US)


def _schedule(spark) -> X.Schedule:
    return X.fixed_calendar(spark, _windows(spark), "CME:ES", ("CME_EQUITY_INDEX", "v1", "0" * 64), RANGE, ("2024-01-01", "2024-01-31"), [(c, d, ["e"]) for c, d in ROLLS], 2, "first-trading-window-start")


SCHEDULE_SQL = f"""{WINDOWS_SQL}, {DATES_SQL}, rl AS (SELECT y.trading_us AS t, l.nxt, l.c FROM (VALUES ('CME:ES:U2023', 'CME:ES:Z2023', DATE '2024-01-05'), ('CME:ES:Z2023', 'CME:ES:H2024', DATE '2024-01-19')) l(c, nxt, d) JOIN td x ON x.trading_date = l.d JOIN td y ON y.rank = x.rank - 2),
 pt AS (SELECT CAST({RANGE[0]} AS BIGINT) AS valid_from, 'CME:ES:U2023' AS contract, CAST(NULL AS VARCHAR) AS rule_key UNION ALL SELECT t, nxt, 'fixed-calendar.offset-2.first-trading-window-start.' || c FROM rl), sc AS (SELECT *, coalesce(lead(valid_from) OVER (ORDER BY valid_from), {RANGE[1]}) AS valid_to FROM pt)"""


@query(f"WITH {SCHEDULE_SQL} SELECT valid_from, valid_to, contract, rule_key FROM sc")
def roll_schedule(spark, sf):
    return _schedule(spark).frame(spark).select("valid_from", "valid_to", "contract", "rule_key")


@query(f"WITH {A.T}, {SCHEDULE_SQL} SELECT ordinal, at_us, contract FROM t LEFT JOIN sc ON at_us >= valid_from AND at_us < valid_to")
def active_contract(spark, sf):
    return X.active_contract(A.trades(spark, sf).select("ordinal", "at_us"), _schedule(spark).frame(spark))


@query(f"WITH {SCHEDULE_SQL} SELECT trading_date, state, greatest(start_us, valid_from) AS start_us, least(end_us, valid_to) AS end_us, contract FROM w JOIN sc ON greatest(start_us, valid_from) < least(end_us, valid_to)")
def contract_segments(spark, sf):
    return X.segments(_windows(spark), _schedule(spark).frame(spark))


@query(f"WITH {A.T}, {SCHEDULE_SQL} SELECT ordinal, CASE WHEN at_us >= {JAN + 3 * A.DAY_US} AND at_us < {JAN + 20 * A.DAY_US} THEN contract END AS contract FROM t LEFT JOIN sc ON at_us >= valid_from AND at_us < valid_to")
def continuous_active(spark, sf):
    series = X.Series("CME:ES:CONTINUOUS:FRONT", _schedule(spark), (JAN + 3 * A.DAY_US, JAN + 20 * A.DAY_US))
    return series.active(A.trades(spark, sf).select("ordinal", "at_us")).select("ordinal", "contract")


# --- lineage and catalog --------------------------------------------------------------------------------------------


def _tree(spark, sf):
    """All orders as a tree: each is the successor of the order of half its key. The root, 1, has none, and 0 would be its own."""
    o = A.load(spark, sf, "orders").where("o_orderkey >= 2")
    return o.select(F.floor(F.col("o_orderkey") / 2).cast("bigint").alias("a"), F.col("o_orderkey").alias("b"), F.sha2(F.col("o_orderkey").cast("string"), 256).alias("relation_hash"))


EDGES = "e AS (SELECT o_orderkey // 2 AS a, o_orderkey AS b, sha256(CAST(o_orderkey AS VARCHAR)) AS relation_hash FROM orders WHERE o_orderkey >= 2)"


@query(f"WITH {EDGES} SELECT a, b, relation_hash FROM e")
def lineage_edges(spark, sf):
    rel = _tree(spark, sf).select(F.array("a").alias("predecessors"), F.col("b").alias("successor"), "relation_hash")
    return L.edges_of(rel)


@query(f"WITH RECURSIVE {EDGES}, walk(start, node) AS (SELECT a, b FROM e WHERE a IN (3, 5, 40, 77) UNION SELECT walk.start, e.b FROM walk JOIN e ON e.a = walk.node) SELECT start, node FROM walk")
def lineage_descendants(spark, sf):
    return L.reachable(_tree(spark, sf), spark.createDataFrame([(3,), (5,), (40,), (77,)], "start bigint"))


@query(f"WITH RECURSIVE {EDGES}, walk(start, node) AS (SELECT b, a FROM e UNION SELECT walk.start, e.a FROM walk JOIN e ON e.b = walk.node) SELECT start, node FROM walk")
def lineage_ancestors(spark, sf):
    e = _tree(spark, sf)
    return L.reachable(e, e.select("b"), backwards=True)


@query(f"WITH RECURSIVE {EDGES}, walk(start, node) AS (SELECT a, b FROM e WHERE a = 40 UNION SELECT walk.start, e.b FROM walk JOIN e ON e.a = walk.node) SELECT start, node FROM walk")
def lineage_recursive_sql(spark, sf):
    return L.reachable_sql(_tree(spark, sf), spark.createDataFrame([(40,)], "start bigint"))


@query(f"WITH RECURSIVE {EDGES}, f AS (SELECT a, b FROM e UNION ALL SELECT b, a // 2 FROM e WHERE b % 97 = 0 AND a > 3), walk(start, node) AS (SELECT a, b FROM f UNION SELECT walk.start, f.b FROM walk JOIN f ON f.a = walk.node) SELECT node FROM walk WHERE start = node")
def lineage_cycles(spark, sf):
    e = _tree(spark, sf).select("a", "b")
    back = e.where("b % 97 = 0 and a > 3").select(F.col("b").alias("a"), F.floor(F.col("a") / 2).alias("b"))
    return L.on_cycles(e.unionByName(back))


@query(f"WITH {EDGES}, m AS (SELECT a AS manifest_hash, relation_hash FROM e UNION SELECT b, relation_hash FROM e) SELECT manifest_hash, string_agg(relation_hash, ',' ORDER BY relation_hash) AS relations FROM m GROUP BY manifest_hash")
def lineage_index(spark, sf):
    return L.index(_tree(spark, sf)).select("manifest_hash", F.concat_ws(",", "relations").alias("relations"))


@query(f"WITH {EDGES} SELECT b AS node FROM e WHERE a = 40")
def lineage_successors(spark, sf):
    return L.successors(_tree(spark, sf), 40)


def _claims(spark, sf):
    o = A.load(spark, sf, "orders")
    key = F.col("o_orderkey")
    sha = lambda c: F.sha2(c.cast("string"), 256)
    claims = o.select(F.when(key % 13 != 0, sha(key % 1000)).alias("manifest_hash"), F.concat(F.lit("f/"), key.cast("string")).alias("location"), sha(key).alias("physical_hash"), sha(key * 3).alias("semantic_hash"))
    files = o.where("o_orderkey % 11 <> 0").select(F.concat(F.lit("f/"), key.cast("string")).alias("location"), sha(F.when(key % 7 == 0, key + 1).otherwise(key)).alias("physical_hash"), sha(F.when(key % 5 == 0, key).otherwise(key * 3)).alias("semantic_hash"))
    return claims, files


OUTCOME_SQL = "oc AS (SELECT CASE WHEN o_orderkey % 13 <> 0 THEN sha256(CAST(o_orderkey % 1000 AS VARCHAR)) END AS manifest_hash, 'f/' || o_orderkey AS location, CASE WHEN o_orderkey % 11 = 0 THEN 'missing_artifact' WHEN o_orderkey % 13 = 0 THEN 'missing_manifest' WHEN o_orderkey % 7 = 0 THEN 'physical_mismatch' WHEN o_orderkey % 5 = 0 THEN 'semantic_mismatch' ELSE 'ok' END AS outcome FROM orders)"


@query(f"WITH {OUTCOME_SQL} SELECT manifest_hash, location, outcome FROM oc")
def catalog_verify_outcome(spark, sf):
    return G.outcomes(*_claims(spark, sf))


@query(f"WITH {OUTCOME_SQL} SELECT manifest_hash, arg_min(outcome, list_position(['ok', 'semantic_mismatch', 'physical_mismatch', 'missing_artifact', 'missing_manifest'], outcome)) AS outcome FROM oc WHERE manifest_hash IS NOT NULL GROUP BY manifest_hash")
def catalog_best_outcome(spark, sf):
    return G.best_outcome(G.outcomes(*_claims(spark, sf)).where("manifest_hash is not null"))


@query("SELECT sha256(CAST(o_orderkey AS VARCHAR)) AS manifest_hash, 'f/' || l_orderkey || '/' || l_linenumber || '/' || l_partkey AS location FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def catalog_locate(spark, sf):
    o, l = A.load(spark, sf, "orders"), A.load(spark, sf, "lineitem")
    m = o.select(F.sha2(F.col("o_orderkey").cast("string"), 256).alias("manifest_hash"), F.col("o_orderkey").alias("physical_hash"))
    entries = l.select(F.col("l_orderkey").alias("physical_hash"), F.concat(F.lit("f/"), F.concat_ws("/", "l_orderkey", "l_linenumber", "l_partkey")).alias("location"))
    return G.locate(m, entries)


@query(f"WITH {A.T} SELECT ordinal, at_us, 'CME:ES:H2024' AS canonical_identity, symbol AS vendor_symbol, price_fp AS price, size, side FROM t")
def migrate_v2_v3(spark, sf):
    from ..operators import storage

    out = storage.stored_rows(A.trades(spark, sf), "trade", A.CONTRACT)
    return out.select("ordinal", F.col("timestamp").alias("at_us"), "canonical_identity", "vendor_symbol", "price", F.col("size").cast("bigint").alias("size"), "side")
