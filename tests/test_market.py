"""Market-data operators: golden values, boundaries, malformed input, round trips, and refusals."""

from __future__ import annotations

import json
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tideframe.functions import encoding as N
from tideframe.functions import exprs as E
from tideframe.operators import calendar as C
from tideframe.operators import catalog as G
from tideframe.operators import compare as M
from tideframe.operators import lineage as L
from tideframe.operators import ordering as O
from tideframe.operators import replay as R
from tideframe.operators import rollover as X
from tideframe.operators import storage as S
from tideframe.operators import validate as V
from tideframe.sources import delimited as D
from tideframe.sources import feeds, profile

CONTRACT = "CME:ES:M2026"
BASE = 1_780_322_400_000_000  # 2026-06-01T14:00Z


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v"))).first()[0]


# --- golden values ---------------------------------------------------------------------------------------------------


def trades(spark, rows):
    df = spark.createDataFrame(rows, "ordinal bigint, timestamp bigint, price bigint, size decimal(20,0), side string")
    return df.withColumn("raw", N.record_bytes("trade", {c: F.col(c) for c in ("timestamp", "price", "size", "side")}))


def test_semantic_hash(spark):
    from decimal import Decimal

    df = trades(spark, [(1, BASE + 1_000_000, 4_500_500_000, Decimal(2), "sell"), (0, BASE, 4_500_250_000, Decimal(1), "buy")])
    want = "735474d8ceb9b2294e6d448ca770fcf986eda91b66a7395c7c75556281497f77"
    assert N.semantic_hash(df, "trade", CONTRACT).first().semantic_hash == want
    assert N.stream_hash(df.repartition(2), "trade", CONTRACT) == want


@pytest.mark.parametrize("value", [0, 1, -1, 2**63 - 1, 2**63, 2**64 - 1, -(2**63)])
def test_be8(spark, value):
    got = spark.createDataFrame([(str(value),)], "v string").select(N.be8(F.col("v").cast("decimal(20,0)"))).first()[0]
    assert bytes(got) == (value % 2**64).to_bytes(8, "big")


def test_packaged_calendar(spark):
    d = C.packaged()
    w = C.materialize(spark, d)
    assert w.count() == 622
    assert C.calendar_hash(d, w) == "aa2dde0ac4e66480f5125d84048516ce6c5b3a680dcad5c2a3d222d68828c6e2"
    first, last = C.supports(w).first()
    points = [first - 1, first, last - 1, last, first + 3_600_000_000 - 1, first + 3_600_000_000]
    got = {r.at_us: r for r in C.resolve(spark.createDataFrame([(p,) for p in points], "at_us bigint"), w).collect()}
    assert [got[p].state for p in points] == [None, "halt", "trading", None, "halt", "trading"]
    assert got[last - 1].next_us is None and got[first].next_us == first + 3_600_000_000
    with pytest.raises(Exception, match="coverage"):
        C.require_covered(C.resolve(spark.createDataFrame([(last,)], "at_us bigint"), w)).collect()
    with pytest.raises(C.DateOutOfRange):
        C.windows_for(w, spark.sql("select date '2024-01-02' as trading_date"), d)


def test_definitions_are_strict():
    text = (Path(C.__file__).parent.parent / "sources/calendars/index_futures_2023.toml").read_text()
    for old, new in (("version = 1", "version = 0"), ('id = "CME_EQUITY_INDEX"', 'id = "CME_EQUITY_INDEX"\nextra = 1'), ("version = 1\n", ""), ('"halt", -1, "16:00", -1, "17:00"', '"closed", -1, "16:00", -1, "17:00"')):
        with pytest.raises(C.BadDefinition):
            C.parse(text.replace(old, new, 1))


def test_gaps_and_folds(spark):
    rows = [("2024-03-10 01:59:59", None), ("2024-03-10 02:30:00", "nonexistent"), ("2024-03-10 03:00:00", None), ("2024-11-03 01:30:00", "ambiguous"), ("2024-11-03 02:00:00", None)]
    at, why = E.local_to_utc(F.col("v").cast("timestamp_ntz"), "America/Chicago")
    got = spark.createDataFrame([(t,) for t, _ in rows], "v string").select("v", at.alias("at"), why.alias("why")).collect()
    assert {r.v: r.why for r in got} == dict(rows)
    assert all((r.at is None) == (r.why is not None) for r in got)


# --- expressions -----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("text", "price", "quantity"),
    [
        ("0.000001", None, "not_whole"),
        ("999999999999.999999", None, "not_whole"),
        ("1000000000000", "magnitude_too_large", None),
        ("5102.7500001", "too_many_fractional_digits", "not_whole"),
        ("5102.7500000000000000000000000", None, "not_whole"),
        ("0.00000000000000000001", "too_many_fractional_digits", "not_whole"),
        ("1.000", None, None),
        ("1e3", None, None),
        (" 5 ", None, None),
        ("0", "not_positive", "not_positive"),
        ("-0.0", "not_positive", "not_positive"),
        ("-1", "not_positive", "not_positive"),
        ("NaN", "non_finite", "non_finite"),
        ("-Infinity", "non_finite", "non_finite"),
        ("", "not_a_number", "not_a_number"),
        ("abc", "not_a_number", "not_a_number"),
        (None, "not_a_number", "not_a_number"),
        ("18446744073709551615", "magnitude_too_large", None),
        ("18446744073709551616", "magnitude_too_large", "magnitude_too_large"),
    ],
)
def test_envelopes(spark, text, price, quantity):
    assert one(spark, text, E.price_violation) == price
    assert one(spark, text, E.quantity_violation) == quantity


@pytest.mark.parametrize(
    ("text", "status", "us"),
    [
        ("2026-06-01T14:00:00.000001+00:00", "valid", BASE + 1),
        ("2026-06-01T14:00:00Z", "valid", BASE),
        ("1969-12-31T23:59:59.999999+00:00", "valid", -1),
        ("2026-06-01T14:00:00", "naive", None),
        ("2026-06-01", "naive", None),
        ("2026-06-01T14:00:00+01:00", "non_utc", None),
        ("2026-02-30T14:00:00Z", "not_datetime", None),
        ("yesterday", "not_datetime", None),
        (None, "not_datetime", None),
    ],
)
def test_timestamps(spark, text, status, us):
    assert one(spark, text, E.timestamp_status) == status
    assert one(spark, text, E.utc_micros) == us


def test_names(spark):
    for name, listed in (("CME:ES:M2026", True), ("CME:ES:A2026", False), ("cme:ES:M2026", False), ("123:ES:M2026", False), ("CME:ES:M0999", False), ("CME:ES", False), ("CME:ES:CONTINUOUS:FRONT", False), (None, False)):
        assert one(spark, name, E.is_listed_contract) is listed
    assert one(spark, "CME:ES:CONTINUOUS:FRONT", E.is_continuous) is True
    assert one(spark, " Buy\t", E.side) == "buy" and one(spark, "cross", E.side) is None
    assert one(spark, "4", lambda c: E.full_year(c, 2020)) == 2024 and one(spark, "4", lambda c: E.full_year(c, 2021)) is None
    with pytest.raises(ValueError):
        X.require_listed("ESM6")


# --- sources ---------------------------------------------------------------------------------------------------------

CSV = """timestamp,instrument_symbol,price,size,side
2026-06-01T14:00:03.000000+00:00,ESM6,5102.25,1,buy
2026-06-01T14:00:00.000001+00:00,ESM6,5102.750000,2,SELL
2026-06-01T14:00:00.000001+00:00,ESM6,5102.750000,2,SELL
2026-06-01T14:00:02.000000+00:00,ESM6,5102.50,"3",unknown
"""


def test_csv_import(spark, tmp_path):
    (tmp_path / "t.csv").write_text(CSV)
    raw = D.fetch_csv(spark, str(tmp_path / "t.csv"), D.Request("trade", "ESM6"), "trade")
    rows, issues = V.import_batch(raw, "trade")
    assert [r.source_index for r in rows.collect()] == [1, 2, 3, 0] and issues.count() == 0
    assert D.fetch_csv(spark, str(tmp_path / "t.csv"), D.Request("trade", "OTHER"), "trade").count() == 0
    assert D.fetch_csv(spark, str(tmp_path / "t.csv"), D.Request("trade", "ESM6", BASE, BASE + 2_000_000), "trade").count() == 2
    with pytest.raises(D.Capability):
        D.fetch_csv(spark, str(tmp_path / "t.csv"), D.Request("bar", "ESM6"), "trade")
    done = G.import_dataset(raw, "trade", str(tmp_path / "out.parquet"), CONTRACT)
    assert done.rows == 4 and S.descriptor(done.path)["canonical_identity"] == CONTRACT
    back, _ = S.read_artifact(spark, done.path, CONTRACT)
    assert [r.at_us - BASE for r in back.orderBy("ordinal").collect()] == [1, 1, 2_000_000, 3_000_000]
    assert str(pq.read_schema(done.path).field("size").type) == "uint64"
    bad = raw.withColumn("price", F.when(F.col("source_index") == 1, "x").otherwise(F.col("price")))
    with pytest.raises(G.ImportFailed, match="non_decimal_price"):
        G.import_dataset(bad, "trade", str(tmp_path / "no.parquet"), CONTRACT)
    assert not (tmp_path / "no.parquet").exists()


@pytest.mark.parametrize(("text", "what"), [("", "no header"), ("a,b,a\n1,2,3\n", "twice"), ("a,b\n1\n", "fields"), ("a,b\n1,2,3\n", "fields")])
def test_malformed_files(spark, tmp_path, text, what):
    (tmp_path / "x.csv").write_text(text)
    with pytest.raises(Exception, match=what):
        D.read_delimited(spark, str(tmp_path / "x.csv")).collect()


def test_requests():
    r = D.Request("trade", "ESM6", 10, 20)
    assert [r.contains(t) for t in (9, 10, 19, 20)] == [False, True, True, False]
    for bad in (("trade", " ESM6"), ("trade", ""), ("trade", "ESM6", 20, 20)):
        with pytest.raises(ValueError):
            D.Request(*bad)


def test_feed_a(spark):
    rows = [(0, "1704196800000000000", "42", "5000250000000", "3", "A"), (1, str(feeds.UNDEFINED_TIME), "42", str(feeds.UNDEFINED_PRICE), "3", "x"), (2, "1704196800000000001", "42", "-1", "3", "b")]
    raw = spark.createDataFrame(rows, "source_index bigint, ts_recv string, instrument_id string, price string, size string, side string")
    got = feeds.feed_a(raw, "trades", {42: "ESH4"}).orderBy("source_index").collect()
    assert [r.at_us for r in got] == [1704196800000000, None, None] and [r.side for r in got] == ["sell", "x", "buy"]
    assert str(got[0].price) == "5000.250000000" and got[1].price is None
    assert feeds.feed_a(raw, "trades", {42: "ESH4"}, truncate=True).orderBy("source_index").collect()[2].at_us == 1704196800000000
    with pytest.raises(Exception, match="no symbol"):
        feeds.feed_a(raw, "trades", {}).collect()
    with pytest.raises(D.NotConfigured):
        feeds.feed_a(raw, "ohlcv", {42: "ESH4"})
    bar = spark.createDataFrame([(0, "1704196800000000000", "42", "1", "2", "1", "1", "5")], "source_index bigint, ts_event string, instrument_id string, open string, high string, low string, close string, volume string")
    assert feeds.feed_a(bar, "ohlcv", {42: "ESH4"}, 60_000_000).first().at_us == 1704196860000000


def test_feed_b(spark):
    rows = [(0, "20240102", "43200000"), (1, "20240310", "9000000"), (2, "20241103", "5400000"), (3, "2024-01-02", "1"), (4, "20240102", "86400000")]
    raw = spark.createDataFrame([(*r, "1", "2", "1", "1", "5") for r in rows], "source_index bigint, date string, ms_of_day string, open string, high string, low string, close string, volume string")
    got = feeds.feed_b(raw, "ohlc", "America/New_York", "ES", 60_000_000, "start").orderBy("source_index").collect()
    assert got[0].at_us == 1704214860000000
    assert [r.time_problem for r in got] == [None, "nonexistent", "ambiguous", "not_a_time", "not_a_time"]
    with pytest.raises(D.NotConfigured):
        feeds.feed_b(raw, "ohlc", "America/New_York", "ES", 60_000_000)


def test_profile(spark, tmp_path):
    (tmp_path / "p.csv").write_text("date,ms_of_day,price,size\n20240102,1,10.25,3\n20240103,2,0,\n20240104,86399999,x,3\n")
    found = profile.inspect(spark, str(tmp_path / "p.csv"))
    by = {c["name"]: c for c in found["columns"]}
    assert found["schemas"] == ["trade"] and by["price"]["decimals"] == 1 and by["price"]["texts"] == 1 and by["size"]["empty"] == 1
    assert by["size"]["examples"] == "3" and "date: looks like YYYYMMDD" in found["findings"]
    assert "price" in profile.report(found)


# --- validation ------------------------------------------------------------------------------------------------------


def bars(spark, rows):
    return spark.createDataFrame(rows, "source_index bigint, timestamp string, instrument_symbol string, interval string, open string, high string, low string, close string, volume string")


def test_bar_groups(spark):
    t = "2026-06-01T14:01:00+00:00"
    raw = bars(spark, [(0, t, "ES", "60", "1", "2", "1", "1", "5"), (1, t, "ES", "60.0", "1.0", "2", "1", "1", "5"), (2, t, "NQ", "60", "1", "2", "1", "1", "5"), (3, t, "NQ", "60", "1", "2", "1", "2", "5"), (4, t, "NQ", "60", "1", "2", "1", "1", "5")])
    got = sorted((r.row_index, r.severity, r.code, r.field_name) for r in V.duplicate_issues(raw, "bar").collect())
    assert got == [(1, "WARNING", "duplicate_row", None)] + [(i, "ERROR", "conflicting_bar", "close") for i in (2, 3, 4)]
    issues = V.all_issues(raw, "bar")
    assert [r.source_index for r in V.survivors(raw, issues, "bar").collect()] == [0]
    assert [r.source_index for r in V.survivors(raw, issues, "bar", "keep_last").collect()] == [1]


def test_gates(spark):
    raw = bars(spark, [(0, "2026-06-01T14:01:00+00:00", "ES", "60", "1", "2", "1", "1", "5")])
    assert [r.code for r in V.import_batch(raw, "bar", 9)[1].collect()] == ["unsupported_schema_version"]
    assert [r.code for r in V.import_batch(raw.where("false"), "bar")[1].collect()] == ["empty_batch"]
    assert V.report(V.all_issues(raw, "bar"), 1, 1).first().success
    early = bars(spark, [(0, "0001-01-01T00:00:30Z", "ES", "60", "1", "2", "1", "1", "5")])
    assert [r.code for r in V.value_issues(early, "bar").collect()] == ["interval_out_of_range"]
    with pytest.raises(ValueError):
        V.one_type(["trade", "bar"])
    extra = raw.withColumn("extra", F.array(F.lit("z"), F.lit("b")))
    assert [(r.code, r.field_name) for r in V.schema_issues(extra, "bar").collect()] == [("unknown_field", "b")]
    assert V.schema_issues(extra, "bar", strict=False).count() == 0


def test_previous_across_ranges(spark):
    df = spark.range(1000).select(F.col("id").alias("o"), (F.col("id") * 7 % 13).alias("v"), (F.col("id") % 3).alias("k")).repartition(5)
    got = {r.o: r.previous for r in O.with_previous(df, "v", "o").collect()}
    assert got == {i: None if i == 0 else (i - 1) * 7 % 13 for i in range(1000)}
    got = {r.o: r.previous for r in O.with_previous(df, "v", "o", "k").collect()}
    assert got == {i: None if i < 3 else (i - 3) * 7 % 13 for i in range(1000)}
    assert {r.o: r.position for r in O.numbered(df.select("o"), "o").collect()} == {i: i for i in range(1000)}


# --- replay, lineage, catalog ----------------------------------------------------------------------------------------


def source(spark, name, times, ordinals=None):
    rows = [(name, o, "trade", BASE + t) for o, t in zip(ordinals or range(len(times)), times)]
    return spark.createDataFrame(rows, "source string, ordinal bigint, record_type string, at_us bigint")


def about(spark, *rows):
    return spark.createDataFrame([(n, h, c, "trade", v) for n, h, c, v in rows], "source string, semantic_hash string, contract string, record_type string, schema_version int")


def test_replay(spark):
    one_, two = source(spark, "a", [0, 5, 5, 9]), source(spark, "b", [5, 9, 12])
    m = about(spark, ("a", "1", "X", 3), ("b", "2", "Y", 3))
    got = R.frames(R.prepare([one_, two], m, BASE + 5, BASE + 12)).orderBy("at_us").collect()
    assert [(r.at_us - BASE, [(e.source, e.ordinal) for e in r.events]) for r in got] == [(5, [("a", 1), ("a", 2), ("b", 0)]), (9, [("a", 3), ("b", 1)])]
    same = R.frame_digest(R.frames(R.prepare([two, one_], m)))
    assert same == R.frame_digest(R.frames(R.prepare([one_.repartition(3), two], m)))
    with pytest.raises(R.NonMonotonic):
        R.prepare([source(spark, "a", [0, 5, 4])], m, BASE + 4)
    with pytest.raises(R.DuplicateSemantics):
        R.prepare([one_, two], about(spark, ("a", "1", "X", 3), ("b", "1", "Y", 3)))
    with pytest.raises(R.AmbiguousOverlap):
        R.prepare([one_, source(spark, "b", [9, 12])], about(spark, ("a", "1", "X", 3), ("b", "2", "X", 3)))
    assert R.prepare([one_, source(spark, "b", [9, 12])], about(spark, ("a", "1", "X", 3), ("b", "2", "X", 3)), BASE + 10).count() == 1
    with pytest.raises(R.UnsupportedSchema):
        R.prepare([one_], about(spark, ("a", "1", "X", 2)))
    with pytest.raises(ValueError):
        R.ReplayConfig(())


def test_a_burst_stays_whole(spark):
    rows = source(spark, "a", [0] * 2000)
    assert R.frame_summary(rows.withColumn("size", F.lit(1)).withColumn("price_fp", F.lit(2))).collect()[0].n_events == 2000
    assert len(R.frames(rows).first().events) == 2000


def test_relations(spark):
    a, b, c = ("a" * 64, "b" * 64, "c" * 64)
    r = L.build_relation(c, [b, a])
    assert L.parse_relation(r.document()) == r and r.hash == L.build_relation(c, [a, b]).hash
    with pytest.raises(L.RelationHashMismatch):
        L.parse_relation(r.document().replace(b"operator", b"operatos"))
    for bad in ((a, [a]), (a, []), (a, [b, b]), ("x", [a])):
        with pytest.raises(L.LineageError):
            L.build_relation(*bad)
    with pytest.raises(L.LineageError):
        L.validate_relation({"record_type": "trade", "contract": "X", "semantic_hash": "1"}, [{"record_type": "trade", "contract": "X", "semantic_hash": "1"}])
    assert L.find_cycle([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")]) == ["a", "b", "c", "a"]
    assert L.find_cycle([("a", "b"), ("b", "c"), ("a", "c")]) is None
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (5, 5)], "a bigint, b bigint")
    starts = spark.createDataFrame([(1,), (4,)], "start bigint")
    assert {tuple(x) for x in L.reachable(edges, starts).collect()} == {(1, 1), (1, 2), (1, 3), (1, 4)} == {tuple(x) for x in L.reachable_sql(edges, starts).collect()}
    assert [x.node for x in L.on_cycles(edges).collect()] == [1, 2, 3, 5]


def test_publishing_relations(tmp_path):
    a, b, c = ("a" * 64, "b" * 64, "c" * 64)
    about_ = {h: {"record_type": "trade", "contract": CONTRACT, "semantic_hash": h} for h in (a, b, c)}
    root = str(tmp_path)
    first, second = L.build_relation(b, [a]), L.build_relation(c, [b])
    assert L.publish_relation(root, first, about_.__getitem__) and not L.publish_relation(root, first, about_.__getitem__)
    L.publish_relation(root, second, about_.__getitem__)
    with pytest.raises(L.LineageCycle):
        L.publish_relation(root, L.build_relation(a, [c]), about_.__getitem__)
    assert {r.hash for r in L.published(root)} == {first.hash, second.hash} and L.read_relation(root, first.hash) == first
    L.verify_index(root)
    (tmp_path / "lineage-index.json").write_bytes(b"{}")
    with pytest.raises(L.LineageIndexError):
        L.verify_index(root)
    L.rebuild_index(root)
    L.verify_index(root)
    with pytest.raises(L.MissingRelation):
        L.read_relation(root, "d" * 64)
    (Path(L.relations_folder(root)) / "x.json.1.partial").write_bytes(b"")
    assert L.partials(root) == ["x.json.1.partial"]
    with pytest.raises(KeyError):
        L.publish_relation(root, L.build_relation("d" * 64, [a]), about_.__getitem__)


def test_provenance():
    assert G.transformation("symbol-mapping", {"ESM6": CONTRACT}, 2)["symbol_mapping"] == [["ESM6", CONTRACT]]
    for bad in (lambda: G.transformation("none", {"ESM6": CONTRACT}), lambda: G.transformation("symbol-mapping", {"ESM6": "ESM6"}), lambda: G.source_provenance("imported", "feed a"), lambda: G.source_provenance("found")):
        with pytest.raises(ValueError):
            bad()


def artifact(spark, path, contract=CONTRACT, n=3):
    from decimal import Decimal

    rows = [(i, BASE + i, "ESM6", Decimal("4500.25") + i, Decimal(2**64 - 1 - i), "buy") for i in range(n)]
    df = spark.createDataFrame(rows, "ordinal bigint, at_us bigint, symbol string, price decimal(18,6), size decimal(20,0), side string")
    S.write_artifact(S.stored_rows(df, "trade", contract), str(path), "trade", 3 if contract else 2, contract)
    return df


def test_catalog(spark, tmp_path):
    root, store = str(tmp_path / "catalog"), tmp_path / "store"
    store.mkdir()
    df = artifact(spark, store / "x.parquet")
    back, _ = S.read_artifact(spark, str(store / "x.parquet"))
    assert M.multiset(df, back.select(df.columns), *df.columns).first().same_multiset
    m = G.build_manifest(spark, str(store / "x.parquet"), G.source_provenance("imported", "FEED_A"))
    assert G.parse_manifest(N.canonical_json(m)) == m
    with pytest.raises(G.ManifestHashMismatch):
        G.parse_manifest(N.canonical_json(m | {"row_count": 4}))
    assert G.register(spark, root, str(store), str(store / "x.parquet"), m) == "registered"
    assert G.register(spark, root, str(store), str(store / "x.parquet"), m) == "already_registered"
    h = m["manifest_hash"]
    assert G.verify_manifest(spark, root, str(store), h) == "ok" and G.verify_manifest(spark, root, str(store), "0" * 64) == "missing_manifest"
    assert G.rebuild_index(spark, root, str(store)) == [("x.parquet", m["physical_hash"])]
    assert [r.manifest_hash for r in G.manifests(spark, root).collect()] == [h]
    artifact(spark, store / "y.parquet", n=2)
    with pytest.raises(G.PhysicalMismatch):
        G.verify_artifact(spark, str(store / "y.parquet"), m)
    with pytest.raises(G.OutsideRoot):
        G.location_of(str(store), "/etc/passwd")
    with pytest.raises(G.Conflict):
        G.with_entry(G.load_index(root), "x.parquet", "1" * 64)
    (store / "x.parquet").unlink()
    assert G.verify_manifest(spark, root, str(store), h) == "missing_artifact"
    assert json.loads(G.index_document([("b", "2"), ("a", "1")]))["entries"][0]["location"] == "a"


def test_migration(spark, tmp_path):
    artifact(spark, tmp_path / "old.parquet", None)
    for bad, what in (({"NQM6": CONTRACT}, "unmapped"), ({"ESM6": CONTRACT, "NQM6": CONTRACT}, "unused")):
        with pytest.raises(G.Migration, match=what):
            G.migrate(spark, str(tmp_path / "old.parquet"), str(tmp_path / "new.parquet"), bad)
    assert G.migrate(spark, str(tmp_path / "old.parquet"), str(tmp_path / "new.parquet"), {"ESM6": CONTRACT}) == CONTRACT
    assert S.read_artifact(spark, str(tmp_path / "new.parquet"), CONTRACT)[0].count() == 3
    with pytest.raises(S.StorageContractError):
        S.read_artifact(spark, str(tmp_path / "new.parquet"), "CME:NQ:M2026")
    with pytest.raises(S.StorageError):
        S.descriptor(str(tmp_path / "none.parquet"))


# --- rolls -----------------------------------------------------------------------------------------------------------


def test_rolls(spark):
    d = C.packaged()
    w = C.materialize(spark, d)
    lo, hi = C.supports(w).first()
    pin = ("CME_EQUITY_INDEX", "v1", C.calendar_hash(d, w))
    lives = [("CME:ES:M2023", "2023-06-16", ["e"]), ("CME:ES:U2023", "2023-09-15", ["e"]), ("CME:ES:Z2023", "2023-12-15", ["e"])]
    s = X.fixed_calendar(spark, w, "CME:ES", pin, (lo, hi), ("2023-05-22", "2023-12-29"), lives, 5, "first-trading-window-start")
    assert s.contracts() == [c for c, _, _ in lives] and len(s.hash()) == 64
    at = s.rolls[0][2]
    got = X.active_contract(spark.createDataFrame([(at - 1,), (at,), (hi,)], "at_us bigint"), s.frame(spark)).orderBy("at_us").collect()
    assert [r.contract for r in got] == ["CME:ES:M2023", "CME:ES:U2023", None]
    cut = X.segments(w, s.frame(spark))
    assert cut.agg(F.sum(F.col("end_us") - F.col("start_us"))).first()[0] == w.agg(F.sum(F.col("end_us") - F.col("start_us"))).first()[0]
    series = X.Series("CME:ES:CONTINUOUS:FRONT", s, (lo, hi))
    assert len(series.hash()) == 64
    X.require_pin(s, pin)
    with pytest.raises(X.CalendarMismatch):
        X.require_pin(s, ("OTHER", "v1", pin[2]))
    with pytest.raises(X.LifecycleMismatch):
        X.fixed_calendar(spark, w, "CME:ES", pin, (lo, hi), ("2023-05-22", "2023-12-29"), [("CME:ES:M2023", "2023-06-17", ["e"]), lives[1]], 5, X.BOUNDARIES[0])
    with pytest.raises(X.InsufficientCoverage):
        X.fixed_calendar(spark, w, "CME:ES", pin, (lo, hi), ("2023-05-22", "2023-12-29"), [("CME:ES:M2023", "2023-05-23", ["e"]), lives[1]], 5, X.BOUNDARIES[0])
    with pytest.raises(X.RollOutsideRange):
        X.explicit("CME:ES", pin, (lo, hi), ("2023-05-22", "2023-12-29"), "CME:ES:M2023", [("CME:ES:M2023", "CME:ES:U2023", hi, ["e"])])
    with pytest.raises(X.RolloverError):
        X.explicit("CME:ES", pin, (lo, hi), ("2023-05-22", "2023-12-29"), "CME:ES:M2023", [("CME:ES:U2023", "CME:ES:Z2023", at, ["e"])])


# --- streams ---------------------------------------------------------------------------------------------------------


def test_streamed_frames(spark, tmp_path):
    from tideframe.streaming import replay_stream as T

    rows = [(i, BASE + i // 3 * 10_000) for i in range(30)]
    for k in range(3):
        part = spark.createDataFrame([(F_, t) for F_, t in rows[k * 10 : k * 10 + 10]], "ordinal bigint, us bigint")
        part.select(F.timestamp_micros("us").alias("timestamp"), F.lit("s").alias("source"), "ordinal", F.lit(1).cast("bigint").alias("size")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    events = T.read_events(spark, str(tmp_path / "in"), "timestamp timestamp, source string, ordinal bigint, size bigint")
    got = T.run_to_table(T.frames(events), str(tmp_path / "streamed"), str(tmp_path / "ck"))
    assert sorted(r.n_events for r in got.collect()) == [3] * 10
    back = events.withColumn("timestamp", F.when(F.col("ordinal") == 17, F.timestamp_micros(F.lit(BASE))).otherwise(F.col("timestamp")))
    found = T.run_to_table(T.steps_back(back), str(tmp_path / "backwards"), str(tmp_path / "ck2"))
    assert [r.ordinal for r in found.collect()] == [17]
