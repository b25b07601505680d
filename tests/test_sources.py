"""Providers, streams of single records, replay from a catalog, guards on stored rows, and rules that fail."""

from __future__ import annotations

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tideframe.functions import exprs as E
from tideframe.functions import files
from tideframe.operators import catalog as G
from tideframe.operators import lineage as L
from tideframe.operators import replay as R
from tideframe.operators import storage as S
from tideframe.operators import validate as V
from tideframe.sources import provider as P
from tideframe.sources.delimited import Capability, Decode, NotConfigured, Request

CONTRACT, BASE = "CME:ES:M2026", 1_767_225_600_000_000


def trades(spark, rows):
    schema = "ordinal bigint, at_us bigint, symbol string, price decimal(18,6), size decimal(20,0), side string"
    return spark.createDataFrame([(i, at, "ESM6", Decimal("4500.25"), Decimal(n), "buy") for i, (at, n) in enumerate(rows)], schema)


def stored(spark, folder, name, rows, contract=CONTRACT):
    path = str(folder / name)
    S.write_artifact(S.stored_rows(trades(spark, rows), "trade", contract), path, "trade", 3 if contract else 2, contract)
    return path


def published(spark, root, store, name, rows):
    path = stored(spark, store, name, rows)
    m = G.build_manifest(spark, path, G.source_provenance("imported", "FEED_A"))
    G.register(spark, root, str(store), path, m)
    return m["manifest_hash"]


@pytest.fixture()
def catalog(tmp_path):
    (tmp_path / "store").mkdir()
    (tmp_path / "root").mkdir()
    return str(tmp_path / "root"), tmp_path / "store"


def test_providers_share_a_protocol(spark, tmp_path):
    (tmp_path / "a.csv").write_text("timestamp,instrument_symbol,price,size,side,note\n2026-01-01T00:00:00Z,ES,4500.25,1,buy,x\n2026-01-01T00:00:01Z,NQ,1,1,buy,x\nnever,ES,1,1,buy,x\n2026-01-02T00:00:00Z,ES,1,1,buy,x\n")
    (tmp_path / "b.csv").write_text("ts_recv,instrument_id,price,size,side\n1767225600000000000,7,4500250000000,1,A\n1767312000000000000,7,4500250000000,1,B\n")
    (tmp_path / "c.csv").write_text("date,ms_of_day,price,size\n20260101,0,4500.25,1\n20260102,0,4500.25,1\n")
    rows = [{"timestamp": "2026-01-01T00:00:00Z", "instrument_symbol": "ES", "price": "1", "size": "1", "side": "buy", "more": "x"}, {"timestamp": None, "instrument_symbol": "NQ"}]
    day = Request("trade", "ES", BASE - 1, BASE + 12 * 3_600_000_000)
    all_ = [P.CsvProvider(str(tmp_path / "a.csv"), "trade"), P.FeedAProvider(str(tmp_path / "b.csv"), "trades", {7: "ES"}), P.FeedBProvider(str(tmp_path / "c.csv"), "trade", "America/Chicago", "ES"), P.MemoryProvider("trade", rows)]
    got = [[r.source_index for r in p.fetch(spark, day).orderBy("source_index").collect()] for p in all_]
    assert got == [[0, 2], [0], [0], [0]]
    for p in all_:
        assert p.capabilities.supports("trade") and not p.capabilities.supports("bar")
        with pytest.raises(Capability):
            p.fetch(spark, Request("bar", "ES"))
    assert not all_[2].capabilities.verified
    assert P.MemoryProvider("trade", rows).rows_frame(spark).first().extra == ["more"]
    with pytest.raises(NotConfigured):
        P.CsvProvider(str(tmp_path / "a.csv"), "trade", "  ").fetch(spark, day)
    (tmp_path / "ragged.csv").write_text("a,b\n1,2\n1\n")
    from tideframe.sources.delimited import read_delimited

    with pytest.raises(Exception, match="has 1 fields"):
        read_delimited(spark, str(tmp_path / "ragged.csv")).collect()
    with pytest.raises(NotConfigured):
        P.configured(" ", "a symbol")
    assert issubclass(Decode, ValueError)


def test_streams_give_each_record_once(spark):
    closed = []
    one = P.RecordStream(iter([1, 2]), lambda: closed.append(1))
    assert list(one) == [1, 2] and one.closed and closed == [1] and list(one) == []
    with P.RecordStream(iter([1, 2]), lambda: closed.append(2)) as two:
        assert next(two) == 1
    assert closed == [1, 2] and list(two) == []

    def broken():
        yield 1
        raise OSError("gone")

    three = P.RecordStream(broken(), lambda: closed.append(3))
    with pytest.raises(OSError):
        list(three)
    assert three.closed and closed == [1, 2, 3]
    df = spark.createDataFrame([(5, "b"), (2, "a")], "source_index bigint, v string")
    assert [r.v for r in P.RecordStream.of(df)] == ["a", "b"]
    kind, batch = P.batch_of(P.stream_of(df, "trade", "mine").drop("provider_name"))
    assert kind == "trade" and sorted((r.source_index, r.v) for r in batch.collect()) == [(0, "a"), (1, "b")]
    mixed = P.stream_of(df, "trade", "mine").unionByName(P.stream_of(df, "bar", "mine"))
    for bad in (mixed, mixed.where("false")):
        with pytest.raises(ValueError, match="one record type"):
            P.batch_of(bad)


def test_replay_of_published_datasets(spark, catalog):
    root, store = catalog
    one = published(spark, root, store, "one.parquet", [(BASE, 1), (BASE, 2), (BASE + 5, 3)])
    two = published(spark, root, store, "two.parquet", [(BASE + 10, 4)])
    rows = R.prepare_from_catalog(spark, root, str(store), R.ReplayConfig((two, one), BASE + 1, None))
    assert sorted((r.source, r.ordinal, int(r["size"])) for r in rows.collect()) == sorted([(one, 2, 3), (two, 0, 4)])
    # A damaged copy is passed over while a good one is left.
    files.write(f"{store}/0-first.parquet", files.read(f"{store}/one.parquet")[:-3])
    held = G.load_index(root)
    digest = dict(held)["one.parquet"]
    G.write_index(root, G.with_entry(held, "0-first.parquet", digest))
    assert R.load_source(spark, root, str(store), one)[0].count() == 3
    files.delete(f"{store}/one.parquet")
    with pytest.raises(G.PhysicalMismatch):  # worse than the one that is missing
        R.load_source(spark, root, str(store), one)
    files.delete(f"{store}/0-first.parquet")
    with pytest.raises(G.MissingArtifact):
        R.prepare_from_catalog(spark, root, str(store), R.ReplayConfig((one, two)))
    with pytest.raises(G.MissingManifest):
        R.load_source(spark, root, str(store), "0" * 64)
    assert G.find_by_location(G.load_index(root), "two.parquet")[0] == "two.parquet" and G.find_by_location(G.load_index(root), "no") is None
    assert {r.location for r in G.entries_frame(spark, root).collect()} == {"0-first.parquet", "one.parquet", "two.parquet"}


def test_replay_refuses(spark, catalog):
    root, store = catalog
    one = published(spark, root, store, "one.parquet", [(BASE, 1), (BASE + 9, 2)])
    touching = published(spark, root, store, "two.parquet", [(BASE + 9, 5)])
    back = published(spark, root, store, "back.parquet", [(BASE + 100, 1), (BASE + 99, 2)])
    load = lambda *h, **k: R.prepare_from_catalog(spark, root, str(store), R.ReplayConfig(h, **k))
    with pytest.raises(R.AmbiguousOverlap):
        load(one, touching)
    assert load(one, touching, start=BASE, end=BASE + 9).count() == 1
    with pytest.raises(R.NonMonotonic):
        load(back, start=BASE + 100)  # whole sources are checked, whatever the range


def test_guards_on_stored_rows(spark, tmp_path):
    for n, rows in enumerate(([(S.LATEST + 1, 1)], [(BASE, 0)])):
        with pytest.raises(S.StorageContractError, match="range_"):
            S.read_artifact(spark, stored(spark, tmp_path, f"{n}.parquet", rows), CONTRACT)
    path = stored(spark, tmp_path, "none.parquet", [])
    assert S.read_artifact(spark, path, CONTRACT)[0].count() == 0
    big = [(BASE + i, 1) for i in range(150_000)]
    back = S.read_artifact(spark, stored(spark, tmp_path, "big.parquet", big), CONTRACT)[0]
    assert back.where(F.col("at_us") - BASE != F.col("ordinal")).count() == 0 and back.count() == 150_000


def test_amounts_that_fail(spark):
    df = spark.createDataFrame([("1.5",)], "v string")
    assert df.select(E.price(F.col("v"))).first()[0] == Decimal("1.5")
    for v, f in (("NaN", E.price), ("-1", E.price), ("1.5", E.quantity), (None, E.price)):
        with pytest.raises(Exception, match="not a"):
            spark.createDataFrame([(v,)], "v string").select(f(F.col("v"))).collect()
    parts = E.product_parts(F.col("v"))
    got = spark.createDataFrame([("CME:ES",), ("CME:ES:M2026",), ("cme:ES",), (None,)], "v string").select(E.is_product(F.col("v")).alias("ok"), parts["root"].alias("root")).collect()
    assert [tuple(r) for r in got] == [(True, "ES"), (False, None), (False, None), (False, None)]


def test_conflicts_name_all_fields(spark):
    bar = lambda i, c, v: (i, "2026-01-01T00:00:00Z", "ES", "60", "1", "3", "1", c, v)
    rows = [bar(0, "2", "5"), bar(1, "2.0", "6"), bar(2, "1", "5"), bar(3, "x", "5")]
    raw = spark.createDataFrame([*rows, (4, "2026-01-02T00:00:00Z", "ES", "60", "1", "3", "1", "2", "5")], "source_index bigint, timestamp string, instrument_symbol string, interval string, open string, high string, low string, close string, volume string")
    assert sorted(tuple(r) for r in V.conflict_details(raw).collect()) == [(i, 0, 4, "close,volume") for i in range(4)]
    same = raw.where("source_index in (0, 4)").unionByName(raw.where("source_index = 0").withColumn("source_index", F.lit(9)).withColumn("close", F.lit("2.000")))
    assert V.conflict_details(same).count() == 0 and [r.row_index for r in V.duplicate_issues(same, "bar").collect()] == [9]


def test_cycles_by_components(spark):
    import random

    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(75)] + [(100, 101), (101, 102), (102, 100), (102, 110), (110, 111), (111, 110), (7, 7)]
    out: dict[int, set[int]] = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)

    def reach(x):
        found, todo = set(), [x]
        while todo:
            for y in out.get(todo.pop(), ()):
                if y not in found:
                    found.add(y)
                    todo.append(y)
        return found

    got = [r.node for r in L.on_cycles(spark.createDataFrame(edges, "a bigint, b bigint")).collect()]
    assert got == sorted(x for x in out if x in reach(x))
    assert L.on_cycles(spark.createDataFrame([(1, 2), (2, 3)], "a bigint, b bigint")).count() == 0
