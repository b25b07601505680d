"""Learned formats where credentials stand bare: in hot sources, in large tables, short, dotted and without digits."""

from __future__ import annotations

import random

CODE = "ABCDEFGHJKLMNPQRSTUVWXYZ23456789"
PROSE = ["considerable", "international", "January", "20240131123", "well-known-thing", "www.example.com", "development", "Tuesday", "and", "the"]


def code(rng, n=24):
    return "".join(rng.choice(CODE) for _ in range(n - 1)) + rng.choice("23456789")


def prose(rng):
    return " ".join(rng.choice(PROSE) + rng.choice(["", "", "s", "ing"]) for _ in range(12))


def table(spark, texts, parts=4):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").repartition(parts)


def test_a_hot_source_of_bare_keys(spark):
    from tideframe.llm.secrets import find_secrets

    rng = random.Random(3)
    texts = [f"{prose(rng)} token={code(rng)} {prose(rng)}" for _ in range(100)]
    texts += [f"{prose(rng)} {code(rng)} {prose(rng)}" for _ in range(300)] + [prose(rng) for _ in range(100)]
    got = {r.doc_id: r.n_format for r in find_secrets(table(spark, texts)).collect()}
    assert sum(got[i] > 0 for i in range(100, 400)) > 270
    assert sum(got[i] > 0 for i in range(400, 500)) < 5


def test_labels_come_from_all_documents(spark):
    from pyspark.sql import functions as F

    from tideframe.llm import secrets as S

    rng = random.Random(4)
    keys = ["AKIA" + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16)) for _ in range(7)]
    held = F.element_at(F.array(*map(F.lit, keys)), (F.col("id") / 3000 + 1).cast("int"))
    rare = F.when(F.col("id") % 3000 == 17, held).otherwise("")
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("token="), F.concat(F.lit("secret="), F.md5(F.col("id").cast("string"))), rare).alias("text"))
    got = S.labelled_credentials(docs)
    assert {v for k, v in got if k == "access"} == set(keys)
    assert sum(k == "assign" for k, _ in got) == S.SAMPLE_RUNS == len({v for k, v in got if k == "assign"})
    assert sorted(got) == sorted(S.labelled_credentials(docs.repartition(7)))


def test_short_dotted_and_digit_free_credentials(spark):
    from tideframe.llm.secrets import find_secrets

    rng = random.Random(6)
    some = lambda n, letters: "".join(rng.choice(letters) for _ in range(n))
    makers = [lambda: some(10, CODE), lambda: ".".join(some(9, CODE) for _ in range(3)), lambda: some(18, CODE[:24])]
    texts = [f"{prose(rng)} token={m()} {prose(rng)}" for m in makers for _ in range(100)]
    texts += [f"{prose(rng)} {m()}. {prose(rng)}" for m in makers for _ in range(50)] + [prose(rng) for _ in range(100)]
    got = {r.doc_id: r for r in find_secrets(table(spark, texts)).collect()}
    for k in range(3):
        assert sum(got[300 + 50 * k + i].n_format > 0 for i in range(50)) > 35, k
    assert sum(got[i].n_format > 0 for i in range(450, 550)) < 10
    assert all(not texts[i][int(r.spans.split(":")[2]) - 1] == "." for i, r in got.items() if r.spans and i >= 300)


def test_automata_keep_formats():
    from tideframe.llm.secrets import infer

    rng = random.Random(5)
    some = lambda n, letters: "".join(rng.choice(letters) for _ in range(n))
    fixed = infer([some(40, "0123456789abcdef") for _ in range(400)])
    assert len(fixed.moves) == 41 and fixed.score(some(40, "0123456789abcdef")) > fixed.score(some(37, "0123456789abcdef")) + 0.1
    keys = infer(["AKIA" + some(16, "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(400)])
    assert len(keys.moves) == 21 and all(len(m) == 1 for m in keys.moves[:4])
    lengths = infer([some(n, "0123456789abcdef") for n in (32, 40, 64) for _ in range(130)])
    assert 65 <= len(lengths.moves) < 80
    loop = infer(["ab" * (1 + int(rng.expovariate(0.4))) for _ in range(400)])
    assert len(loop.moves) < 8 and loop.score("ab" * 9) > -1.5


def test_held_out_precision_and_recall(spark):
    """Bare credentials that no label shows, of the labelled formats, among prose, numbers, card-like numbers, dates and addresses."""
    from tideframe.llm.secrets import find_secrets

    rng = random.Random(9)
    some = lambda n, letters: "".join(rng.choice(letters) for _ in range(n))
    makers = {"hex": lambda: some(40, "0123456789abcdef"), "key": lambda: "AKIA" + some(16, CODE), "live": lambda: "sk_live_" + some(24, CODE + CODE[:24].lower())}
    others = [lambda: some(16, "0123456789"), lambda: f"20{some(2, '0123456789')}-01-1{some(1, '0123456789')}", lambda: "www.example.com/" + rng.choice(PROSE), lambda: "-".join(some(4, "0123456789") for _ in range(4)), lambda: rng.choice(PROSE) * 3]
    texts, truth = [], []
    for m in makers.values():
        for _ in range(150):
            texts.append(f"{prose(rng)} token={m()} {prose(rng)}")
            truth.append(None)
    for k, m in makers.items():
        if k != "key":  # AKIA is a pattern of its own, and hex of 32 or more too
            for _ in range(100):
                texts.append(f"{prose(rng)} {m()[:31] if k == 'hex' else m()} {prose(rng)}")
                truth.append(k == "live")
    for m in others:
        for _ in range(200):
            texts.append(f"{prose(rng)} {m()} {prose(rng)}")
            truth.append(False)
    got = {r.doc_id: r.n_format > 0 for r in find_secrets(table(spark, texts)).collect()}
    live = [i for i, t in enumerate(truth) if t]
    flagged = [i for i, t in enumerate(truth) if t is not None and got[i]]
    recall = sum(got[i] for i in live) / len(live)
    # What begins a hex digest is like one but for its end, so it may be flagged; prose, numbers and addresses may not.
    precision = 1 - sum(got[i] for i, t in enumerate(truth) if t is False and i >= len(truth) - 1000) / max(1, len(flagged))
    print("recall", recall, "precision", precision)
    assert recall >= 0.9 and precision >= 0.95
