"""Each operator against a plain version over a small table of awkward rows, and over an empty table."""

from __future__ import annotations

import base64
import collections
import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

SPACE = r"[\x20\x09-\x0D]+"


def vocabulary(name):
    import public_tokenizers

    return str(public_tokenizers.path(name))


def split(t):
    return [w for w in re.split(SPACE, t or "") if w]


def encoded(name, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary(name))
    return lambda x: t.encode(x or "", add_special_tokens=False).ids + [end]


# --- 1 ---------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("plain_specials", [False, True])
@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_gives_the_librarys_ids(name, plain_specials, monkeypatch):
    import random

    from tokenizers import Tokenizer

    from tideframe.llm import tokens

    rng = random.Random(3)
    parts = ["a", "B", "don't", "'s", " ", " ", "  ", "\n", "\t", " ", "Σ", "é", "é.", "́", "12", "²", "_", "x.", "!?", "漢字", "😀", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "\x85", "\x1c", "İ", "İ.", "I'LL", "ß", "…", "|", "ª.", "ǅ;"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(4000)] + ["", None, " "]
    plainly = Tokenizer.from_file(vocabulary(name))
    plainly.encode_special_tokens = plain_specials
    want = [x.ids for x in plainly.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    own = tokens.Encoder(vocabulary(name), plain_specials)
    monkeypatch.setattr(tokens, "MEMO", 700)  # words are forgotten and met again
    for part in (texts, texts[2000:], texts):
        ids, bounds = own.encode(pa.array(part, pa.string()))
        for i, x in enumerate(want[-len(part) :]):
            assert ids[bounds[i] : bounds[i + 1]].tolist() == x, part[i]
    ids, bounds = own.encode(pa.array(texts, pa.string()).slice(1000, 500))
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == want[1000:1500]
    own = tokens.Encoder(vocabulary(name), plain_specials)
    for k in range(0, 4000, 50):
        own.encode(pa.array(texts[k : k + 50], pa.string()))
    assert len(own.known.one) <= 700


def test_token_store_round_trip(spark, docs, rows, empty, tmp_path):
    from tideframe.llm.token_store import read_digests, read_documents, write_store

    store = write_store(docs, f"file://{tmp_path}/store", vocabulary("word_bpe_49k.json"), 1)
    found = read_digests(spark, store).orderBy("start").collect()
    whole = {r.start: r.ids for r in read_documents(spark, store).collect()}
    ids = encoded("word_bpe_49k.json", 1)
    want = collections.Counter((r[0], len(i := ids(r[1])), zlib.crc32(np.array(i, "<u4").tobytes())) for r in rows)
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in found) == want
    at, last = 0, -1
    for r in found:
        assert r.start == at and (-1 if r.doc_id is None else r.doc_id) >= last
        assert zlib.crc32(np.array(whole[r.start], "<u4").tobytes()) == r.ids_crc32 and len(whole[r.start]) == r.n_tokens
        at, last = at + r.n_tokens, -1 if r.doc_id is None else r.doc_id
    chunks = store.table(spark, "chunks")
    assert chunks.count() == chunks.select("digest").distinct().count()
    assert read_digests(spark, write_store(empty, f"file://{tmp_path}/none", vocabulary("word_bpe_49k.json"), 1)).count() == 0


def test_token_store_finds_damage(spark, docs, tmp_path):
    from pyspark.sql import functions as F

    from tideframe.llm.token_store import TokenStore, read_digests, write_store

    write_store(docs.where("doc_id < 9"), f"file://{tmp_path}/good", vocabulary("word_bpe_49k.json"), 1)
    bad = TokenStore(f"file://{tmp_path}/bad")
    for name in ("chunks", "recipes", "manifest"):
        df = spark.read.parquet(f"file://{tmp_path}/good/{name}")
        if name == "chunks":
            df = df.withColumn("ids", F.concat(F.unhex(F.lit("0100")), F.expr("substring(ids, 3, length(ids) - 2)")))
        df.write.parquet(f"{bad.path}/{name}")
    with pytest.raises(Exception, match="doesn't hold|chunk"):
        read_digests(spark, bad).collect()


def test_crc_shares():
    from tideframe.llm.token_store import shift_crc

    rng = np.random.default_rng(1)
    parts = [rng.bytes(int(n)) for n in rng.integers(0, 5000, 40)]
    behind = np.array([sum(map(len, parts[i + 1 :])) for i in range(len(parts))])
    shares = shift_crc(np.array([zlib.crc32(p) for p in parts]), behind)
    assert int(np.bitwise_xor.reduce(shares)) == zlib.crc32(b"".join(parts))


def test_equal_passages_share_chunks():
    from tideframe.llm.token_store import MAX_CHUNK, MIN_CHUNK, cut_points

    rng = np.random.default_rng(2)
    one = rng.integers(0, 49_000, 20_000).astype(np.uint32)
    two = np.concatenate([rng.integers(0, 49_000, 700).astype(np.uint32), one])
    a, b = cut_points(np.concatenate([one, two]), np.array([0, len(one), len(one) + len(two)]))
    assert set(np.diff(np.r_[0, a])[1:-1].tolist()) <= set(range(MIN_CHUNK, MAX_CHUNK + 1))
    hold = lambda x, ends: {x[s:e].tobytes() for s, e in zip([0, *ends[:-1]], ends)}
    assert len(hold(one, a) & hold(two, b)) > 0.9 * len(a)


# --- 2 ---------------------------------------------------------------------------------------------------------------


def _equal_groups(rows):
    by = collections.defaultdict(list)
    for r in rows:
        by[re.sub(SPACE, " ", r[1] or "")].append(r[0])
    return by


def test_exact_duplicates(docs, rows, empty):
    from tideframe.llm.exact_dedup import exact_duplicates

    found = exact_duplicates(docs).collect()
    by = _equal_groups(rows)
    assert len(found) == len(rows)
    seen = collections.Counter()
    for r in found:
        text = next(t for t in by if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256)
        ids = [i for i in by[text] if i is not None]
        assert r.group_size == len(by[text]) and r.keep_id == (min(ids) if ids else None)
        seen[text] += r.kept
        assert not r.kept or r.doc_id == r.keep_id
    assert set(seen.values()) == {1}
    assert exact_duplicates(empty).count() == 0


def test_keep_first(docs, rows, empty):
    from tideframe.llm.exact_dedup import keep_first

    out = keep_first(docs)
    assert out.columns == docs.columns
    by = _equal_groups(rows)
    kept = out.collect()
    assert collections.Counter(re.sub(SPACE, " ", r.text or "") for r in kept) == dict.fromkeys(by, 1)
    assert all(r.h == "x" for r in kept)
    assert {r.doc_id for r in kept} == {min((i for i in v if i is not None), default=None) for v in by.values()}
    assert keep_first(empty).count() == 0


def test_filter_slices(spark, monkeypatch):
    from pyspark.sql import functions as F

    from tideframe.llm import exact_dedup as D
    from tideframe.llm.common import staged

    keys = staged(spark.range(3000).select(F.xxhash64(F.col("id") % 2500).alias("h"), "id"), "keys")
    twice = keys.groupBy("h").count().where("count > 1").select("h")
    for bits in (1 << 28, 1 << 14):
        monkeypatch.setattr(D, "MOST_BITS", bits)
        assert (D._slices(3000) > 1) == (bits == 1 << 14)
        flagged = D.flag_repeated(keys, "flags")
        assert sorted(r.id for r in flagged.collect()) == list(range(3000))
        assert flagged.where("not maybe").join(twice, "h", "left_semi").count() == 0
        assert flagged.where("maybe").count() < 1600
        bloom, plane = D.repeated_filter(keys.select("h"), "filter")
        assert bloom.has(plane, np.array([r.h for r in twice.collect()])).all()
        assert bits < 1 << 28 or bloom.has(plane, np.array([r.h for r in keys.join(twice, "h", "left_anti").collect()])).mean() < 0.05


def test_groups_that_hold_much(spark):
    from tideframe.llm.exact_dedup import exact_duplicates, keep_first

    rows = [(i, "same  words" if i % 3 else f"own words {i // 2}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r for r in exact_duplicates(docs).collect()}
    assert len(got) == 3000 and all(got[i].group_size == 2000 and got[i].keep_id == 1 for i in range(3000) if i % 3)
    assert {r.doc_id for r in keep_first(docs).collect()} == {i for i, r in got.items() if r.kept}


# --- 3 ---------------------------------------------------------------------------------------------------------------


def _spans(t):
    t, out = t or "", []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.I | re.A):
        if len(m[2]) >= 8:
            out.append((m.start(), 0, f"assign:{m.start()}:{m.end()}"))
    out += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    out += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
    return [x[2] for x in sorted(out)]


def test_secrets(docs, rows, empty):
    from tideframe.llm.secrets import find_secrets

    got = find_secrets(docs).collect()
    found = collections.Counter((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got)
    want = collections.Counter()
    for r in rows:
        s = _spans(r[1])
        want[(r[0], *(sum(x.startswith(k) for x in s) for k in ("assign", "access", "hex")), hashlib.sha256(",".join(s).encode()).hexdigest())] += 1
    assert found == want
    for r in got:
        assert len(r.spans.split(",") if r.spans else []) == r.n_assign + r.n_access + r.n_hex + r.n_format
    assert find_secrets(empty).count() == 0


def test_inferred_formats_generalise():
    import random

    from tideframe.llm.secrets import fit_formats, infer

    rng = random.Random(5)
    key = lambda: "AKIA" + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16))
    digest = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40))
    word = lambda: "".join(rng.choice("aeinorst") for _ in range(rng.randint(12, 20)))
    labelled = [("access", key()) for _ in range(200)] + [("hex", digest()) for _ in range(200)] + [("ordinary", word()) for _ in range(200)]
    formats = fit_formats(labelled)
    assert len(formats.kinds["access"].moves) < 200  # merged, from some thousands of prefixes
    assert sum(formats.score(key()) >= formats.threshold for _ in range(100)) > 80
    assert sum(formats.score(digest()) >= formats.threshold for _ in range(100)) > 80
    assert sum(formats.score(word()) >= formats.threshold for _ in range(100)) < 5
    assert fit_formats([]) is None
    assert infer(["ab", "ab", "abab"]).score("ab") < 0


# --- 4 ---------------------------------------------------------------------------------------------------------------


def test_packing(docs, rows, empty):
    from tideframe.llm.packing import pack_documents

    got = pack_documents(docs, vocabulary("byte_bpe_50k.json"), 2).collect()
    ids = encoded("byte_bpe_50k.json", 2)
    want = collections.Counter()
    total = 0
    for r in rows:
        x = ids(r[1])
        total += len(x)
        first = (len(x) - 1) % 1024 + 1
        at = 0
        for k in range(-(-len(x) // 1024)):
            n = first if k == 0 else 1024
            want[(r[0], k, at, n, zlib.crc32(np.array(x[at : at + n], "<u4").tobytes()))] += 1
            at += n
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by = collections.defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for s in by.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= 1024
    assert len(by) <= -(-total // 1024) + 2
    assert pack_documents(empty, vocabulary("byte_bpe_50k.json"), 2).count() == 0


def test_sum_of_squares_against_its_definition():
    from tideframe.llm.packing import sum_of_squares

    rng = np.random.default_rng(4)
    sizes = rng.integers(1, 30, 300)
    bins, places = sum_of_squares(sizes, 40)
    gaps: list[int] = []
    for s, b, p in zip(sizes.tolist(), bins.tolist(), places.tolist()):
        def cost(after):
            counts = collections.Counter(g for g in after if 0 < g < 40)
            return sum(n * n for n in counts.values())

        options = [cost([*gaps[:i], g - s, *gaps[i + 1 :]]) for i, g in enumerate(gaps) if g >= s]
        assert (b == len(gaps)) == (not options)
        if b == len(gaps):
            gaps.append(40)
            options = [cost([*gaps[:-1], 40 - s])]
        assert places is not None and p == 40 - gaps[b] and gaps[b] >= s
        gaps[b] -= s
        assert cost(gaps) == min(options)


def test_packing_is_near_its_bound(spark, monkeypatch):
    from tideframe.llm import packing as P

    rng = np.random.default_rng(8)
    sizes = np.concatenate([rng.integers(20, 900, 6000), np.full(900, 1024), rng.integers(1, 30, 600)])
    items = spark.createDataFrame([(i, int(s)) for i, s in enumerate(sizes)], "key bigint, size bigint")
    for block, over in ((20_000, 1.001), (1000, 1.01)):
        monkeypatch.setattr(P, "BLOCK_ITEMS", block)
        got = P.pack(items, 1024).collect()
        by = collections.defaultdict(list)
        for r in got:
            by[r.sequence_id].append((r.offset, int(sizes[r.key])))
        assert len(got) == len(sizes)
        for s in by.values():
            s.sort()
            assert s[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(s, s[1:])) and s[-1][0] + s[-1][1] <= 1024
        assert len(by) <= over * -(-int(sizes.sum()) // 1024) + 1


# --- 5 ---------------------------------------------------------------------------------------------------------------


def _sets(rows):
    out = []
    for r in rows:
        w = split(r[1])
        out.append((r[0], frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])))
    return out


def _near(rows):
    s = [x for x in _sets(rows) if x[0] is not None]
    links, parent = collections.Counter(), {i: i for i, _ in s}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(s):
        for b, y in s[:i]:
            if x and y and 5 * len(x & y) >= 4 * len(x | y):
                links[a] += 1
                links[b] += 1
                p, q = sorted((top(a), top(b)))
                parent[q] = p
    return links, {i: top(i) for i, _ in s}


def test_near_duplicates(docs, rows, empty):
    from tideframe.llm.ngram_join import near_duplicates

    got = near_duplicates(docs).collect()
    assert len(got) == len(rows)
    links, top = _near(rows)
    times = collections.Counter(r[0] for r in rows)
    for r in got:
        if r.doc_id is None:
            assert r.class_id is None and r.n_links == 0
            continue
        assert r.class_id == top[r.doc_id], r
        assert r.n_links == links[r.doc_id] // times[r.doc_id], r
    assert near_duplicates(empty).count() == 0


def test_blocks_lose_no_link(docs, rows, monkeypatch):
    from tideframe.llm import ngram_join

    monkeypatch.setattr(ngram_join, "BLOCK", 3)
    links, top = _near(rows)
    times = collections.Counter(r[0] for r in rows)
    for r in ngram_join.near_duplicates(docs).where("doc_id is not null").collect():
        assert (r.class_id, r.n_links) == (top[r.doc_id], links[r.doc_id] // times[r.doc_id])


def test_keep_one(docs, rows, empty):
    from tideframe.llm.ngram_join import keep_one

    out = keep_one(docs)
    assert out.columns == docs.columns
    _, top = _near(rows)
    assert {r.doc_id for r in out.collect()} == set(top.values()) | {None}
    assert keep_one(empty).count() == 0


def test_forest_reaches_its_recall():
    from tideframe.llm.ngram_join import DEPTH, RECALL, TREES, reach, shallowest, signature

    depth = shallowest(0.8)
    assert reach(0.8, depth) >= RECALL > reach(0.8, depth + 1) and shallowest(0.8, 0.9) >= depth >= shallowest(0.5)
    rng, met, alike = np.random.default_rng(6), 0, 0.0
    for _ in range(300):
        both, *own = (rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) for n in (160, 20, 20))
        x, y = (signature(np.concatenate([both, o])).reshape(TREES, DEPTH) for o in own)
        met += bool((x[:, :depth] == y[:, :depth]).all(axis=1).any())
        alike += float((x == y).mean()) / 300
    assert met / 300 >= RECALL - 0.01 and abs(alike - 0.8) < 0.01


def test_prefixes_are_shortened(spark, monkeypatch):
    """A pair that no whole path tells is found by shorter ones; documents with near copies stop before that."""
    from tideframe.llm import ngram_join as J

    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 16, J.TREES * J.DEPTH, dtype=np.uint64).astype(">u2")
    short = base.copy().reshape(J.TREES, J.DEPTH)
    short[:, 6:] = rng.integers(0, 1 << 16, (J.TREES, 2), dtype=np.uint64).astype(">u2")
    copy = base.copy()
    copy[:8] += 1
    other = rng.integers(0, 1 << 16, J.TREES * J.DEPTH, dtype=np.uint64).astype(">u2")
    rows = [(i, 100, bytearray(x.tobytes())) for i, x in enumerate((base, short, other))]
    table = lambda r: spark.createDataFrame(r, "doc_id bigint, n int, paths binary")
    depths = []
    old = J.nodes
    monkeypatch.setattr(J, "nodes", lambda reps, depth, *c: (depths.append((depth, reps.where("open").count() if "open" in c else None)), old(reps, depth, *c))[1])
    assert {(r.a, r.b) for r in J.forest_edges(table(rows), 0.8, J.RECALL).collect()} in ({(0, 1)}, {(1, 0)})
    assert depths == [(8, 3), (7, 3), (6, 3)]
    depths.clear()
    J.forest_edges(table([*rows[2:], (5, 100, bytearray(base.tobytes())), (6, 100, bytearray(copy.tobytes()))]), 0.8, J.RECALL).collect()
    assert depths == [(8, 3), (7, 1), (6, 1)]


def test_blocks_connect_by_all_links():
    """Documents 1-4, 2-3 and 3-4 are linked: no document's smallest neighbour tells that 2 and 1 belong together."""
    from tideframe.llm.ngram_join import _parts

    linked = np.zeros((4, 4), bool)
    for i, j in ((0, 3), (1, 2), (2, 3)):
        linked[i, j] = linked[j, i] = True
    assert _parts(linked, np.array([1, 2, 3, 4])).tolist() == [1, 1, 1, 1]


def test_large_groups_by_blocks(spark, monkeypatch):
    """A chain of near copies of several bases, in many small blocks, against brute force."""
    import random

    from tideframe.llm import ngram_join as J

    rng = random.Random(11)
    rows = []
    for g in range(3):
        text = [f"w{g}x{i}" for i in range(60)]
        for k in range(25):
            text = list(text)
            text[rng.randrange(60)] = f"c{g}x{k}"
            rows.append((len(rows), " ".join(text)))
    want, top = _near(rows)
    monkeypatch.setattr(J, "BLOCK", 4)
    monkeypatch.setattr(J, "NODE_BLOCK", 5)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: (r.class_id, r.n_links) for r in J.near_duplicates(docs).collect()}
    assert got == {i: (top[i], want[i]) for i, _ in rows}


def test_components(spark):
    from tideframe.llm.ngram_join import components

    edges = [(i, i + 1) for i in range(10, 40)] + [(100, 7), (7, 9), (50, 51)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 10 for i in range(10, 41)}, 100: 7, 7: 7, 9: 7, 50: 50, 51: 50}


# --- 6 ---------------------------------------------------------------------------------------------------------------

PAGES = [(1, "http://a", "<p>x</p>"), (2, "http://b", "<p>x</p>"), (5, None, "<p>x</p>"), (3, "http://c\r\nX: y", "äß"), (4, "http://d", None), (6, "http://e", ""), (None, "http://f", "only"), (7, "http://g", "z" * 300_000), (7, "http://g", "z" * 300_000)]


@pytest.mark.parametrize("sent", [200_000, 0])
def test_warc(spark, sent, monkeypatch):
    from tideframe.llm import warc
    from tideframe.llm.warc import archive

    monkeypatch.setattr(warc, "SENT", sent)

    pages = spark.createDataFrame([(*p, "x") for p in PAGES], "page_id bigint, url string, html string, payload string")
    got = collections.Counter(tuple(r) for r in archive(pages).collect())
    want = collections.Counter()
    for page, _, html in PAGES:
        raw = (html or "").encode()
        same = [p for p, _, h in PAGES if (h or "").encode() == raw and p is not None]
        last = max(same, default=None)
        refers = last if len([1 for _, _, h in PAGES if (h or "").encode() == raw]) > 1 and page != last else None
        want[(page, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if refers is None else "revisit", refers)] += 1
    assert got == want
    assert archive(pages.where("false")).count() == 0


def test_warc_pushdown(spark, tmp_path):
    from pyspark.sql import functions as F

    from tideframe.llm import warc

    pages = spark.createDataFrame(PAGES, "page_id bigint, url string, html string")
    warc.write_pages(pages, f"file://{tmp_path}/w")
    df = warc.read_pages(spark, f"file://{tmp_path}/w")
    assert {r.page_id for r in df.where("record_type = 'revisit'").collect()} == {1, 2, 4}
    assert [bytes(r.payload) for r in df.where("page_id = 3").collect()] == ["äß".encode()]
    assert df.where("page_id > 4 and record_type = 'response'").count() == 4
    reader = warc.WarcReader({"path": f"file://{tmp_path}/w"})
    from pyspark.sql.datasource import EqualTo, StringContains

    left = list(reader.pushFilters([EqualTo(("record_type",), "revisit"), StringContains(("target_uri",), "a")]))
    assert len(left) == 1 and len(reader.filters) == 1
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 3
    assert all(r.payload is None for r in warc.read_pages(spark, f"file://{tmp_path}/w", payload=False).select(F.col("payload")).collect())


# --- 7 ---------------------------------------------------------------------------------------------------------------


def test_toxicity(spark, docs, rows, empty):
    import random

    from tideframe.llm.toxicity import keep_clean, toxicity

    rng = random.Random(8)
    neutral = lambda n: " ".join("".join(rng.choice("abcdeilmnoprst") for _ in range(5)) for _ in range(n))
    texts = [(1000 + i, neutral(40) + (" you wretched scoundrel " + neutral(5) if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(400)]
    table = spark.createDataFrame([(i, t) for i, t, _ in texts], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in texts] + [(5, 1, None), (None, 1, 0)], "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity(table, labels).collect()}
    for i, _, y in texts:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
    held = [(got[i].predicted, y) for i, _, y in texts if got[i].held_out]
    assert sum(p == y for p, y in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    awkward = toxicity(docs, labels).collect()
    assert len(awkward) == len(rows) and not any(r.score is None for r in awkward)
    # Rejected rows are those that score high, whatever other columns are called.
    named = table.selectExpr("doc_id", "text", "1 as Score", "2 as __score", "3 as score_", "4 as c0")
    stay = keep_clean(named, labels)
    assert stay.columns == named.columns
    assert {r.doc_id for r in stay.collect()} == {i for i in got if not got[i].predicted} and 0 < stay.count() < 400
    out = keep_clean(docs, labels.where("false"))
    assert out.columns == docs.columns and out.count() == len(rows)  # nothing learned, nothing rejected
    assert toxicity(empty, labels).count() == 0


# --- 8 ---------------------------------------------------------------------------------------------------------------


def test_targets():
    from tideframe.llm.mixing import targets

    sizes, weights = [100, 1000, 50, 0], [3, 1, 2, 3]
    got = targets(sizes, weights, 1.5 * sum(sizes))
    assert got[0] == 200 and got[2] == 100 and got[3] == 0 and got[1] == pytest.approx(1725 - 300)
    assert targets([], [], 0) == []


def test_fit_counts_is_exact_where_it_can_be():
    from tideframe.llm.mixing import fit_counts

    rng = np.random.default_rng(9)
    for _ in range(30):
        lengths = rng.choice(np.arange(3, 400), 12, replace=False)
        counts = rng.integers(1, 6, 12)
        total = int((lengths * counts).sum())
        budget = int(rng.integers(0, total + 1))
        take = fit_counts(lengths, counts, budget)
        got = int((take * lengths).sum())
        assert (take >= 0).all() and (take <= counts).all() and got <= budget
        assert budget - got <= 3 or budget < 400 or total - budget < 400
    big = fit_counts(np.array([7, 11, 10_000]), np.array([10**6, 10**6, 50]), 9_000_001)
    assert int((big * np.array([7, 11, 10_000])).sum()) == 9_000_001


def test_fit_counts_beyond_the_table(monkeypatch):
    """Against all subsets: lengths far beyond the program's table, where the greedy choice is far off."""
    import itertools

    from tideframe.llm.mixing import fit_counts

    rng = np.random.default_rng(12)
    for _ in range(40):
        lengths = rng.choice(np.arange(70_000, 900_000), 8, replace=False)
        counts = np.ones(8, np.int64)
        budget = int(rng.integers(70_000, lengths.sum()))
        take = fit_counts(lengths, counts, budget)
        got = int((take * lengths).sum())
        best = max(sum(x) for k in range(9) for x in itertools.combinations(lengths.tolist(), k) if sum(x) <= budget)
        assert got <= budget and got >= 0.999 * best


def test_names_that_clash(spark):
    """Columns that differ by case only, or have the names that operators use, are carried as they are."""
    from tideframe.llm.exact_dedup import keep_first
    from tideframe.llm.mixing import mix_documents
    from tideframe.llm.ngram_join import keep_one

    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        docs = spark.range(20).selectExpr("id as doc_id", "concat('text number ', cast(id % 7 as string), ' and more of it') as text", "'x' as source", "1 as Text", "2 as DOC_ID", "3 as __id", "4 as __key", "5 as sha", "6 as c1", "7 as `a b`", "8 as copy")
        for keep, n in ((keep_first, 7), (keep_one, 7), (mix_documents, None)):
            out = keep(docs)
            assert out.columns == docs.columns
            rows = out.collect()
            assert (n is None or len(rows) == n) and all(tuple(r)[3:] == (1, 2, 3, 4, 5, 6, 7, 8) for r in rows)
    finally:
        spark.conf.set("spark.sql.caseSensitive", "false")


def test_mix(docs, rows, empty):
    from tideframe.llm.mixing import mix_documents, plan_mix, targets

    got = plan_mix(docs).collect()
    assert len(got) == len(rows)
    size = collections.defaultdict(int)
    for r in rows:
        size[r[3]] += len(split(r[1]))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    goal = dict(zip(order, targets([size[s] for s in order], [3.0, 1.0, 2.0, 3.0][: len(order)], 1.5 * sum(size.values()))))
    source = {r[0]: r[3] for r in rows}
    taken = collections.defaultdict(int)
    for r in got:
        s = "a" if r.doc_id is None else source[r.doc_id]
        assert r.target == pytest.approx(goal[s]) and r.source_size == size[s] and 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    for s in order:
        # As near as whole documents allow: a source whose longest text outweighs the gap can't come nearer.
        longest = max(len(split(r[1])) for r in rows if r[3] == s)
        assert taken[s] <= goal[s] + 1 and goal[s] - taken[s] <= max(0.02 * goal[s], 60, longest if longest > 0.5 * size[s] else 0), s
    again = plan_mix(docs).collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(map(tuple, again))
    out = mix_documents(docs)
    assert out.columns == docs.columns and all(r["size"] == "x" for r in out.collect())
    assert plan_mix(empty).count() == 0 and mix_documents(empty).count() == 0


def test_mix_by_broadcast_and_by_shuffle(docs, spark):
    """Both ways take the same rows as often, as the plan says, and the first moves no text."""
    from tideframe.llm.mixing import mix_documents, plan_mix

    many = spark.range(3000).selectExpr("id as doc_id", "repeat('word ', cast(1 + id % 3 as int)) as text", "'en' as lang", "if(id % 3 = 0, null, cast(id % 2 as string)) as source")
    for table, seed in ((docs, 1), (many, 1), (many, 2)):
        ways = [collections.Counter(map(tuple, mix_documents(table, seed=seed, decisions=d).collect())) for d in (1 << 18, 0)]
        assert ways[0] == ways[1] and ways[0]
    times = {r.doc_id: r.times for r in plan_mix(many, seed=2).collect() if r.times}
    assert times == collections.Counter(r.doc_id for r in mix_documents(many, seed=2).collect())
    assert "Exchange hashpartitioning" not in mix_documents(many)._jdf.queryExecution().executedPlan().toString()


# --- 9 ---------------------------------------------------------------------------------------------------------------


def _repeats(rows):
    seen = collections.Counter()
    texts = [(r[0], (r[1] or "").encode()) for r in rows]
    for _, b in texts:
        seen.update(b[k : k + 200] for k in range(len(b) - 199))
    out = collections.Counter()
    for i, b in texts:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 199):
            if seen[b[k : k + 200]] > 1:
                gone[k : k + 200] = True
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out[(i, len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())] += 1
    return out


@pytest.mark.parametrize(("batches", "group", "held"), [(3, 16_384, 400_000), (7, 16_384, 400_000), (1, 2, 400_000), (5, 2, 3)])
def test_repeats(docs, rows, batches, group, held, monkeypatch):
    from tideframe.llm import suffix_dedup
    from tideframe.llm.suffix_dedup import remove_repeats

    monkeypatch.setattr(suffix_dedup, "HELD", held)
    assert collections.Counter(map(tuple, remove_repeats(docs, batches, group).collect())) == _repeats(rows)


def test_repeats_of_nothing(empty):
    from tideframe.llm.suffix_dedup import remove_repeats

    assert remove_repeats(empty).count() == 0


def test_levels_are_in_order_and_merge(spark, docs):
    """Five batches leave levels of one and four; each is in its order, and holds every run once."""
    from pyspark.sql import functions as F

    from tideframe.llm import suffix_dedup as S

    own = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), "text")
    occurrences = own.mapInArrow(S._entries, "anchor bigint, right bigint, left bigint, run1 bigint, run2 bigint, doc_id bigint, row bigint, lo int, hi int, spot bigint").cache()
    family = S.IndexFamily()
    for i in range(5):
        family.add(occurrences.where(F.pmod("row", F.lit(5)) == i))
    assert [x is not None for x in family.levels] == [True, False, True]
    for level, batches in ((family.levels[0], (4,)), (family.levels[2], (0, 1, 2, 3))):
        want = collections.Counter(tuple(r) for r in occurrences.where(F.pmod("row", F.lit(5)).isin(*batches)).select(*S.ORDER).collect())
        assert {tuple(r)[:5]: r.n for r in level.collect()} == want and level.count() == len(want)
        parts = level.select(*S.ORDER, F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("i")).orderBy("f", "i").collect()
        assert all(tuple(x)[:5] < tuple(y)[:5] for x, y in zip(parts, parts[1:]) if x.f == y.f)


def test_open_entries_are_those_that_can_match():
    """Whether two entries of an anchor share LENGTH bytes follows from their texts; what isn't open never does."""
    from tideframe.llm import suffix_dedup as S

    rng = np.random.default_rng(4)
    middle = rng.integers(97, 123, 32).astype(np.uint8)
    texts, sides = [], [rng.integers(97, 123, 170).astype(np.uint8) for _ in range(2)]
    for _ in range(40):
        a, b = (s.copy() for s in sides)
        a[: rng.integers(0, 171)] = 33
        b[170 - rng.integers(0, 171) :] = 34
        texts.append(np.concatenate([a, rng.integers(48, 58, 0).astype(np.uint8), middle, b]))
    raw, ends = np.concatenate(texts), np.cumsum([len(t) for t in texts])
    n = len(texts)
    right, left = S.contexts(raw, ends, np.arange(n), ends - 372 + 170)
    zero = np.zeros(n, np.int64)
    order = np.lexsort((left.view(np.int64), right.view(np.int64)))
    columns = {"anchor": zero, "right": right.view(np.int64), "left": left.view(np.int64), "run1": np.arange(n), "run2": zero, "n": zero + 1, "spot": np.arange(n)}
    out = S._merged(pa.table({k: v[order] for k, v in columns.items()}), False)
    open_ = dict(zip(out["spot"].to_pylist(), out["open"].to_pylist()))
    for i in range(n):
        longest = 0
        for j in range(n):
            if i != j:
                same = texts[i] == texts[j]
                behind = int(np.argmin(np.append(same[170:], False)))
                before = int(np.argmin(np.append(same[169::-1], False)))
                longest = max(longest, before + behind)
        assert open_[i] or longest < S.LENGTH
    assert not all(open_.values())


def test_runs_cover_all_windows():
    from tideframe.llm.suffix_dedup import LENGTH, K, runs

    rng = np.random.default_rng(10)
    texts = [rng.integers(97, 101, n).astype(np.uint8) for n in (0, 150, 199, 200, 201, 5000, 230)] + [np.full(700, 97, np.uint8)]
    raw, ends = np.concatenate(texts), np.cumsum([len(t) for t in texts])
    text, lo, hi, anchor, _ = runs(raw, ends)
    covered = np.concatenate([np.arange(a, b + 1) for a, b in zip(lo, hi)])
    want = [s + k for s, t in zip(ends - [len(t) for t in texts], texts) for k in range(len(t) - LENGTH + 1)]
    assert covered.tolist() == want
    assert ((anchor >= hi) & (anchor + K <= lo + LENGTH)).all()


# --- 10 --------------------------------------------------------------------------------------------------------------


def test_quality(spark, docs, rows, empty):
    from tideframe.llm.quality import FEATURES, Rule, fit_rules, judge, learn_rules, verdict, with_statistics

    got = judge(docs, []).collect()
    want = collections.Counter()
    for r in rows:
        t, w = r[1] or "", split(r[1])
        windows = collections.Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        covered = {k + j for k in range(len(w) - 2) if windows[tuple(w[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if split(x)]
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        want[(r[0], len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), failed, not failed)] += 1
    assert collections.Counter(map(tuple, got)) == want
    bad = [({f: 0.0 for f in FEATURES} | {"symbols": float(i % 2), "upper": 0.1 * (i % 7)}, i % 2) for i in range(300)]
    rules = learn_rules(bad)
    assert rules and all(Rule.holds(rules[0], x) == bool(y) for x, y in bad)
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert fit_rules(docs, labels) == []
    stats = with_statistics(docs.select("doc_id", "text")).withColumn("kept", verdict(rules)).collect()
    assert all(r.kept == (not rules[0].holds(r.asDict())) for r in stats)
    assert judge(empty, rules).count() == 0


# --- the pipeline ----------------------------------------------------------------------------------------------------


def test_pipeline(spark, docs, rows, tmp_path):
    import corpus_pipeline as P

    folder = f"file://{tmp_path}"
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    assert [n for n, _ in P.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mix", "pack"]
    df = spark.read.parquet(f"{folder}/documents.parquet")
    by = _equal_groups(rows)
    for name, stage in P.STAGES[:-1]:
        before = df
        df = stage(spark, df, folder)
        assert df.columns == docs.columns
        df.write.parquet(f"{folder}/{name}")
        df = spark.read.parquet(f"{folder}/{name}")
        if name == "toxicity":
            assert df.count() == len(rows)
        if name == "exact_dedup":
            assert df.count() == len(by)
        if name == "near_dedup":
            _, top = _near([tuple(r) for r in before.collect()])
            assert {r.doc_id for r in df.collect()} - {None} == set(top.values())
    packed = P.STAGES[-1][1](spark, df, folder)
    assert packed.where("piece = 0").count() == df.count()
    assert P.run(spark, folder).count() == packed.count()
