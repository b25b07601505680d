"""Registered queries against brute force on small tables that reach beyond any range or share of ids."""

from __future__ import annotations

import collections
import hashlib

import pytest

from tideframe.plans import market_queries as Q

N_ORDERS = 4500


def sha(x) -> str:
    return hashlib.sha256(str(x).encode()).hexdigest()


@pytest.fixture(scope="module")
def orders(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("orders")
    spark.range(N_ORDERS).toDF("o_orderkey").write.parquet(f"{folder}/orders.parquet")
    return str(folder)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def below(start: int, out: dict[int, list[int]]) -> set[int]:
    found, todo = set(), [start]
    while todo:
        for y in out.get(todo.pop(), ()):
            if y not in found:
                found.add(y)
                todo.append(y)
    return found


def test_lineage_of_all_orders(spark, orders):
    edges = [(b // 2, b) for b in range(2, N_ORDERS)]
    out, relations = collections.defaultdict(list), collections.defaultdict(set)
    for a, b in edges:
        out[a].append(b)
        relations[a].add(sha(b))
        relations[b].add(sha(b))
    assert rows_of(Q.lineage_edges(spark, orders)) == [(a, b, sha(b)) for a, b in edges]
    assert rows_of(Q.lineage_descendants(spark, orders)) == sorted((s, x) for s in (3, 5, 40, 77) for x in below(s, out))
    assert rows_of(Q.lineage_recursive_sql(spark, orders)) == sorted((40, x) for x in below(40, out))
    assert rows_of(Q.lineage_ancestors(spark, orders)) == sorted((b, b >> k) for b in range(2, N_ORDERS) for k in range(1, b.bit_length()))
    assert rows_of(Q.lineage_index(spark, orders)) == sorted((m, ",".join(sorted(r))) for m, r in relations.items())
    assert rows_of(Q.lineage_successors(spark, orders)) == [(80,), (81,)]
    for a, b in edges:
        if b % 97 == 0 and a > 3:
            out[b].append(a // 2)
    assert rows_of(Q.lineage_cycles(spark, orders)) == sorted((x,) for x in list(out) if x in below(x, out))


def test_overlaps_of_all_trades(spark, tmp_path):
    from datetime import datetime, timedelta

    at = lambda i: datetime(2024, 1, 1) + timedelta(hours=i * 37 % 200)
    events = [(i, at(i), i % 4, "purchase", 1.5) for i in range(60)]
    spark.createDataFrame(events, "event_id bigint, ts timestamp, user_id bigint, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    spans = {}
    for i, t, user, *_ in events:
        lo, hi = spans.get((user, i % 7 + 1), (t, t))
        spans[user, i % 7 + 1] = min(lo, t), max(hi, t)
    name = lambda k: f"U{k[0]}/{k[1]}"
    want = sorted((name(x), name(y)) for x in spans for y in spans if x[0] == y[0] and name(x) < name(y) and spans[x][1] >= spans[y][0] and spans[y][1] >= spans[x][0])
    assert want and rows_of(Q.replay_overlap_conflicts(spark, str(tmp_path)).select("a", "b")) == want


def test_locations_of_all_orders(spark, tmp_path):
    spark.range(50).toDF("o_orderkey").write.parquet(f"{tmp_path}/orders.parquet")
    items = [(k, n, k * 10 + n) for k in range(45) for n in range(1, k % 4 + 1)]
    spark.createDataFrame(items, "l_orderkey bigint, l_linenumber int, l_partkey bigint").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert rows_of(Q.catalog_locate(spark, str(tmp_path))) == sorted((sha(k), f"f/{k}/{n}/{p}") for k, n, p in items)


def test_ordering_of_records_that_share_an_index(spark):
    """Records of one index come earliest first, wherever they are stored; 40 indices in two ranges have their edges among shared ones."""
    from tideframe.operators import validate as V

    rows = [(i, i * 5 % 7 + k * 3 % 5) for i in range(40) for k in range(4)]
    text = [(i, f"2024-01-01T{h:02d}:00:00+00:00") for i, h in rows]
    ordered = sorted(rows)
    want = sorted((y[0], "descending_timestamp" if y[1] < x[1] else "ambiguous_timestamp_order") for x, y in zip(ordered, ordered[1:]) if y[1] <= x[1])
    for given in (text, text[::-1], sorted(text, key=lambda x: (x[1], -x[0]))):
        raw = spark.createDataFrame(given, "source_index bigint, timestamp string").repartition(3)
        assert rows_of(V.ordering_issues(raw).select("row_index", "code")) == want


@pytest.mark.parametrize("next_of", [lambda x: x // 2, lambda x: x - 1, lambda x: (x * 7 + 3) % 50, lambda x: x, lambda x: 0 if x else None], ids=["tree", "chain", "cycles", "loops", "star"])
def test_chains_of_single_steps(spark, next_of):
    from tideframe.operators import lineage as L

    step = {x: next_of(x) for x in range(1, 60)}
    pairs = [(x, y) for x, y in step.items()]
    want = sorted((x, y) for x in step for y in below(x, {a: [b] for a, b in step.items()}))
    edges = spark.createDataFrame(pairs, "a bigint, b bigint")
    assert rows_of(L.reachable(edges, edges.select("a").unionByName(edges.select("a")))) == want
    few = spark.createDataFrame([(5,), (41,), (99,)], "start bigint")
    assert rows_of(L.reachable(edges, few)) == [p for p in want if p[0] in (5, 41)]
    most = edges.where("a > 20").select("a")
    assert rows_of(L.reachable(edges, most)) == [p for p in want if p[0] > 20]


def test_ancestors_take_no_round_for_each_step(spark, orders, monkeypatch):
    """12 steps to the root: rounds double, and no round writes again what those before it found."""
    from tideframe.operators import lineage as L

    written = []
    kept = L.materialized
    monkeypatch.setattr(L, "materialized", lambda df: written.append(kept(df)) or written[-1])
    found = Q.lineage_ancestors(spark, orders).count()
    assert len(written) <= 6 and sum(df.count() for df in written) < found / 2


def test_descendants_write_a_pair_again_as_tables_double(spark, monkeypatch):
    from tideframe.operators import lineage as L

    written = []
    kept = L.materialized
    monkeypatch.setattr(L, "materialized", lambda df: written.append(kept(df)) or written[-1])
    edges = spark.createDataFrame([(i, i + d) for i in range(20) for d in (1, 20)], "a bigint, b bigint")
    found = rows_of(L.reachable(edges, edges.select("a")))
    out = {i: [i + 1, i + 20] for i in range(20)}
    assert found == sorted((s, x) for s in out for x in below(s, out))
    assert sum(df.count() for df in written) < 5 * len(found)
