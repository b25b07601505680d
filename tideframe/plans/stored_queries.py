"""Registered queries that write and read: files, artifacts, catalogs, migrations, imports and replay from a catalog. Also rules that need no
table of their own. Each has an oracle over the tables that the files were made of."""

from __future__ import annotations

import uuid
from dataclasses import replace
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import encoding as N
from ..functions import exprs as E
from ..functions import files
from ..operators import calendar as C
from ..operators import catalog as G
from ..operators import replay as R
from ..operators import storage as S
from ..operators import validate as V
from ..operators.cut import shared_folder
from ..sources import provider as P
from . import adapters as A
from .market_queries import BAR_GROUPS, JAN, TRADE_HEX, H, _be8, query


def _folder(spark, name: str) -> str:
    """A folder of this run's own in the shared one."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _made(folder: str) -> str:
    fs, own = files.at(folder)
    fs.create_dir(own, recursive=True)
    return folder


def _artifact(spark, rows: DataFrame, path: str, contract: str | None = A.CONTRACT) -> str:
    """Trades as a stored artifact."""
    S.write_artifact(S.stored_rows(rows, "trade", contract), path, "trade", 3 if contract else 2, contract)
    return path


def _trades(spark, sf) -> DataFrame:
    """The trades that are valid records: a price of nothing is none, and storage and imports refuse it."""
    return A.trades(spark, sf).where("price_fp > 0")


V_T = A.T.replace("t AS (", "a AS (", 1) + ", t AS (SELECT * FROM a WHERE price_fp > 0)"
RANKED = f"{V_T}, o AS (SELECT * REPLACE (row_number() OVER (ORDER BY ordinal) - 1 AS ordinal) FROM t)"


@query(f"WITH {RANKED} SELECT ordinal, at_us, symbol, price_fp, size, side FROM o")
def storage_round_trip(spark, sf):
    path = _artifact(spark, _trades(spark, sf), f"{_made(_folder(spark, 'stored'))}/a.parquet")
    back, _ = S.read_artifact(spark, path, A.CONTRACT, "trade")
    return back.select("ordinal", "at_us", "symbol", E.fixed_point(F.col("price")).alias("price_fp"), F.col("size").cast("bigint").alias("size"), "side")


@query(f"""WITH {V_T} SELECT 'trade' AS record_type, '{A.CONTRACT}' AS contract, count(*) AS row_count, min(at_us) AS min_timestamp, max(at_us) AS max_timestamp, count(DISTINCT symbol) AS n_symbols,
 sha256(unhex('{N.header('trade', A.CONTRACT).hex()}' || string_agg({TRADE_HEX}, '' ORDER BY ordinal) || {_be8('count(*)')})) AS semantic_hash FROM t""")
def manifest_facts(spark, sf):
    path = _artifact(spark, _trades(spark, sf), f"{_made(_folder(spark, 'manifest'))}/a.parquet")
    m = G.build_manifest(spark, path, G.source_provenance("imported", "FEED_A"))
    row = (m["record_type"], m["contract"], m["row_count"], m["min_timestamp"], m["max_timestamp"], len(m["source"]["vendor_symbols"]), m["semantic_hash"])
    return spark.createDataFrame([row], "record_type string, contract string, row_count bigint, min_timestamp bigint, max_timestamp bigint, n_symbols bigint, semantic_hash string")


CUT, RANGE = JAN + 15 * A.DAY_US, (JAN + 7 * A.DAY_US, JAN + 21 * A.DAY_US)


@query(f"""WITH {V_T}, o AS (SELECT *, row_number() OVER (PARTITION BY at_us >= {CUT} ORDER BY ordinal) - 1 AS place FROM t WHERE TRUE), c AS (SELECT at_us // {H} * {H} AS at_us, place, size, price_fp FROM o WHERE at_us >= {RANGE[0]} AND at_us < {RANGE[1]})
 SELECT at_us, count(*) AS n_events, min(place) AS first_ordinal, max(place) AS last_ordinal, CAST(sum(size) AS BIGINT) AS volume, CAST(sum(price_fp * size) AS BIGINT) AS notional_fp FROM c GROUP BY at_us""")
def replay_from_catalog(spark, sf):
    """Two published datasets, one of them with a damaged copy that comes first, verified, loaded and replayed over a range."""
    base = _folder(spark, "catalog")
    root, store = _made(f"{base}/catalog"), _made(f"{base}/files")
    t, hashes = _trades(spark, sf), []
    for name, rows in (("one", t.where(F.col("at_us") < CUT)), ("two", t.where(F.col("at_us") >= CUT))):
        path = _artifact(spark, rows, f"{store}/m-{name}.parquet")
        m = G.build_manifest(spark, path, G.source_provenance("imported", "FEED_A"))
        G.register(spark, root, store, path, m)
        hashes.append(m["manifest_hash"])
        files.write(f"{store}/a-{name}.parquet", files.read(path)[:-7])
        G.write_index(root, G.with_entry(G.load_index(root), f"a-{name}.parquet", m["physical_hash"]))
    rows = R.prepare_from_catalog(spark, root, store, R.ReplayConfig(tuple(hashes), *RANGE))
    return R.frame_summary(A.coarse(rows.withColumn("price_fp", E.fixed_point(F.col("price"))).withColumn("size", F.col("size").cast("bigint"))))


@query(f"WITH {V_T}, m AS (SELECT DISTINCT symbol FROM t) SELECT 'f/' || symbol AS location, CASE WHEN hash_ok THEN sha256(symbol) END AS physical_hash FROM (SELECT symbol, CAST(substring(symbol, 2) AS BIGINT) % 3 > 0 AS hash_ok FROM m)")
def catalog_by_location(spark, sf):
    m = _trades(spark, sf).select("symbol").distinct()
    location = F.concat(F.lit("f/"), "symbol").alias("location")
    entries = m.where("cast(substring(symbol, 2) as bigint) % 3 > 0").select(location, F.sha2("symbol", 256).alias("physical_hash"))
    return G.located(entries, m.select(location))


@query(f"WITH {RANKED} SELECT ordinal, at_us, '{A.CONTRACT}' AS contract, symbol, price_fp, size, side FROM o")
def migrate_artifact(spark, sf):
    """A version 2 file rewritten as version 3, with a mapping for each of its symbols."""
    folder = _made(_folder(spark, "migrated"))
    t = _trades(spark, sf)
    old = _artifact(spark, t, f"{folder}/old.parquet", None)
    mapping = {r.symbol: A.CONTRACT for r in t.select("symbol").distinct().collect()}  # what an operator would have written down
    contract = G.migrate(spark, old, f"{folder}/new.parquet", mapping)
    back, _ = S.read_artifact(spark, f"{folder}/new.parquet", contract)
    return back.select("ordinal", "at_us", F.lit(contract).alias("contract"), "symbol", E.fixed_point(F.col("price")).alias("price_fp"), F.col("size").cast("bigint").alias("size"), "side")


def _texts(spark, sf) -> DataFrame:
    """Trades as texts without defects."""
    at = F.concat(F.date_format(F.timestamp_micros("at_us"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z")).alias("timestamp")
    return _trades(spark, sf).select(F.col("ordinal").alias("source_index"), at, F.col("symbol").alias("instrument_symbol"), F.col("price").cast("string").alias("price"), F.col("size").cast("string").alias("size"), "side")


@query(f"WITH {V_T} SELECT row_number() OVER (ORDER BY at_us, ordinal) - 1 AS ordinal, at_us, symbol, price_fp, size, side FROM t")
def import_end_to_end(spark, sf):
    path = f"{_made(_folder(spark, 'imported'))}/a.parquet"
    done = G.import_dataset(_texts(spark, sf), "trade", path, A.CONTRACT)
    back, _ = S.read_artifact(spark, done.path, A.CONTRACT)
    return back.select("ordinal", "at_us", "symbol", E.fixed_point(F.col("price")).alias("price_fp"), F.col("size").cast("bigint").alias("size"), "side")


@query(f"WITH {V_T} SELECT at_us, symbol, price_fp, size, side FROM t WHERE symbol = 'U5' AND at_us >= {RANGE[0]} AND at_us < {RANGE[1]}")
def provider_window(spark, sf):
    """What a request asks of delimited files, read by the source of our own."""
    folder = _folder(spark, "delimited")
    _texts(spark, sf).drop("source_index").write.option("header", "true").csv(folder)
    found = P.CsvProvider(f"{folder}/part-*.csv", "trade").fetch(spark, P.Request("trade", "U5", *RANGE))
    return V.normalized(found, "trade").select("at_us", F.col("instrument_symbol").alias("symbol"), E.fixed_point(F.col("price")).alias("price_fp"), F.col("size").cast("bigint").alias("size"), "side")


@query(f"WITH {V_T} SELECT symbol, count(*) AS n, CAST(sum(size) AS BIGINT) AS volume FROM t GROUP BY symbol")
def delimited_scan(spark, sf):
    folder = _folder(spark, "scanned")
    _texts(spark, sf).drop("source_index").write.option("header", "true").csv(folder)
    from ..sources.delimited import read_delimited

    rows = read_delimited(spark, f"{folder}/part-*.csv")
    return rows.groupBy(F.col("instrument_symbol").alias("symbol")).agg(F.count("source_index").alias("n"), F.sum(F.col("size").cast("bigint")).cast("bigint").alias("volume"))


# --- rules ------------------------------------------------------------------------------------------------------------

PRODUCTS = "SELECT event_id AS id, concat(CASE event_id % 4 WHEN 0 THEN 'CME' WHEN 1 THEN 'XCBT' WHEN 2 THEN '123' ELSE 'cme' END, ':', CASE event_id % 3 WHEN 0 THEN 'ES' WHEN 1 THEN '6E' ELSE 'TOOLONGROOTNAME' END, CASE WHEN event_id % 5 = 0 THEN ':M2024' ELSE '' END) AS name FROM {src}"


@query(f"WITH n AS ({A.duck(PRODUCTS, 'events')}), o AS (SELECT id, string_split(name, ':') AS s FROM n), k AS (SELECT *, len(s) = 2 AND s[1] IN ('CME', 'XCBT') AND s[2] IN ('ES', '6E') AS ok FROM o) SELECT id, ok AS product, CASE WHEN ok THEN s[1] END AS venue, CASE WHEN ok THEN s[2] END AS root FROM k")
def product_parse(spark, sf):
    n = spark.sql(PRODUCTS, src=A.load(spark, sf, "events"))
    return n.select("id", E.is_product(F.col("name")).alias("product"), *[c.alias(k) for k, c in E.product_parts(F.col("name")).items()])


@query(f"WITH {V_T} SELECT ordinal, price_fp, size FROM t")
def checked_amounts(spark, sf):
    """Prices and quantities by the form that fails on anything else."""
    own = _texts(spark, sf)
    return own.select(F.col("source_index").alias("ordinal"), E.fixed_point(E.price(F.col("price"))).alias("price_fp"), E.quantity(F.col("size")).cast("bigint").alias("size"))


NAMES = "concat_ws(',', " + ", ".join(f"CASE WHEN d_{c} THEN '{c}' END" for c in ("open", "high", "low", "close", "volume")) + ")"


@query(f"WITH {A.RB}, {BAR_GROUPS} SELECT source_index AS row_index, f AS first_index, n, {NAMES} AS differing FROM m WHERE {NAMES} <> ''")
def bar_conflict_details(spark, sf):
    return V.conflict_details(A.raw_bars(spark, sf))


@query(f"WITH {A.Q} SELECT ordinal, upper({' || '.join(_be8(c) for c in ('at_us', 'bid_fp', 'ask_fp', 'bid_size', 'ask_size'))}) AS bytes FROM q")
def quote_bytes(spark, sf):
    names = {"timestamp": "at_us", "bid": "bid_fp", "ask": "ask_fp", "bid_size": "bid_size", "ask_size": "ask_size"}
    return A.quotes(spark, sf).select("ordinal", F.hex(N.record_bytes("quote", {k: F.col(v) for k, v in names.items()})).alias("bytes"))


@query(f"WITH {A.B} SELECT ordinal, upper({' || '.join(_be8(c) for c in ('at_us', 'interval_us', 'open', 'high', 'low', 'close', 'volume'))}) AS bytes FROM b")
def bar_bytes(spark, sf):
    names = {"timestamp": "at_us", "interval": "interval_us", **{c: c for c in ("open", "high", "low", "close", "volume")}}
    return A.bars(spark, sf).select("ordinal", F.hex(N.record_bytes("bar", {k: F.col(v) for k, v in names.items()})).alias("bytes"))


# The packaged calendar over the winter of 2023, when Chicago is six hours behind UTC, with its exceptions.


def _winter() -> C.Definition:
    d, first = C.packaged(), date(2023, 11, 13)
    inside = lambda rows: [r for r in rows if r["trading_date"] >= first]
    return replace(d, first=first, exceptions=inside(d.exceptions), windows=inside(d.windows))


def _winter_sql() -> str:
    d, minute = _winter(), "CAST({} AS BIGINT) * 86400000000 + epoch_us(CAST('1970-01-01 ' || {} AS TIMESTAMP))"
    rules = ", ".join(f"({r['weekday']}, '{r['rule_key']}', '{r['state']}', {r['start_day']}, '{r['start_time']}', {r['end_day']}, '{r['end_time']}')" for r in d.weekly)
    gone = ", ".join(f"(DATE '{x['trading_date']}')" for x in d.exceptions)
    own = ", ".join(f"(DATE '{w['trading_date']}', '{w['rule_key']}', '{w['state']}', TIMESTAMP '{w['start']}', TIMESTAMP '{w['end']}')" for w in d.windows)
    day = "epoch_us(CAST(x AS TIMESTAMP))"
    return f"""WITH r(wd, rule_key, state, d0, t0, d1, t1) AS (VALUES {rules}), e(trading_date) AS (VALUES {gone}), own(trading_date, rule_key, state, a, b) AS (VALUES {own}),
 d AS (SELECT CAST(x AS DATE) AS trading_date, isodow(x) - 1 AS wd, {day} AS at0 FROM generate_series(TIMESTAMP '{d.first}', TIMESTAMP '{d.last}', INTERVAL 1 DAY) g(x))
 SELECT at0 + {minute.format('d0', 't0')} + 6 * {H} AS start_us, at0 + {minute.format('d1', 't1')} + 6 * {H} AS end_us, state, trading_date, rule_key FROM d JOIN r USING (wd) WHERE trading_date NOT IN (SELECT trading_date FROM e)
 UNION ALL SELECT epoch_us(a) + 6 * {H}, epoch_us(b) + 6 * {H}, state, trading_date, rule_key FROM own"""


@query(_winter_sql())
def calendar_exceptions(spark, sf):
    return C.materialize(spark, _winter()).select("start_us", "end_us", "state", "trading_date", "rule_key")
