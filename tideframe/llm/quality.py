"""Quality rules: decision lists learned by sequential covering, on Spark expressions only.

Statistics of each text are built-in functions over its words and lines. From a bounded sample of labelled rows, rules are
grown one condition at a time by information gain, pruned on rows that growing didn't see, and kept where those bear them
out; covered rows go, and the next rule is grown. The list becomes one ordered CASE expression over the statistics.

Words are runs of other than ASCII white space; null text has none. Empty tables and tables without labels give no rules.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, plain

SYMBOLS = "#*$%&|<>"
#: Labelled rows that a fit sees at most.
SAMPLE = 8000


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, SPACES, " " * len(SPACES)), " "), "")


def with_statistics(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, more) with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and further shares that rules use."""
    t = F.coalesce(F.col("`text`"), F.lit(""))
    df = docs.withColumn("__t", t).withColumn("__w", _words(F.col("__t")))
    n = F.size("__w")
    df = df.withColumn("__n", n)
    # Three-word windows by their hash; only texts in which one repeats need the places.
    df = df.withColumn("__h", F.expr("if(__n < 3, cast(array() as array<bigint>), transform(sequence(0, __n - 3), i -> xxhash64(__w[i], __w[i + 1], __w[i + 2])))"))
    df = df.withColumn("__s", F.expr("if(size(array_distinct(__h)) = size(__h), cast(array() as array<struct<h:bigint,i:int>>), sort_array(transform(__h, (h, i) -> struct(h, i))))"))
    df = df.withColumn("__p", F.expr("sort_array(transform(filter(__s, (x, k) -> (k > 0 and __s[k - 1].h = x.h) or (k < size(__s) - 1 and __s[k + 1].h = x.h)), x -> x.i))"))
    repeat = F.expr("aggregate(__p, struct(0 as n, -3 as last), (a, i) -> struct(a.n + least(3, i - a.last) as n, i as last)).n")
    lines = F.expr("filter(split(__t, '\\n'), x -> length(translate(x, ' \\t\\n\\u000b\\u000c\\r', '')) > 0)")
    df = df.withColumn("__l", lines)
    chars = F.length(F.translate("__t", SPACES, ""))
    per_word = lambda c: c / F.greatest(F.col("n_words"), F.lit(1))
    upper = F.length("__t") - F.length(F.expr("translate(__t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')"))
    marks = F.length("__t") - F.length(F.expr("translate(__t, '!?', '')"))
    digits = F.length("__t") - F.length(F.expr("translate(__t, '0123456789', '')"))
    return (
        df.withColumn("n_words", F.col("__n").cast("bigint"))
        .withColumn("word_chars", chars.cast("bigint"))
        .withColumn("n_symbols", (F.length("__t") - F.length(F.translate("__t", SYMBOLS, ""))).cast("bigint"))
        .withColumn("n_dup_lines", (F.size("__l") - F.size(F.array_distinct("__l"))).cast("bigint"))
        .withColumn("n_repeat_words", repeat.cast("bigint"))
        .withColumn("words", F.col("n_words").cast("double"))
        .withColumn("mean_word", per_word(F.col("word_chars")))
        .withColumn("symbols", per_word(F.col("n_symbols")))
        .withColumn("dup_lines", F.col("n_dup_lines") / F.greatest(F.size("__l"), F.lit(1)))
        .withColumn("repeats", per_word(F.col("n_repeat_words")))
        .withColumn("upper", upper / F.greatest(F.col("word_chars"), F.lit(1)))
        .withColumn("marks", per_word(marks))
        .withColumn("digits", digits / F.greatest(F.col("word_chars"), F.lit(1)))
        .withColumn("distinct_words", per_word(F.size(F.array_distinct("__w"))))
        .drop("__t", "__w", "__n", "__h", "__s", "__p", "__l")
    )


FEATURES = ["words", "mean_word", "symbols", "dup_lines", "repeats", "upper", "marks", "digits", "distinct_words"]


@dataclass(frozen=True)
class Rule:
    """Rejects rows that meet all conditions (feature, whether above, threshold)."""

    conditions: tuple[tuple[str, bool, float], ...]

    def holds(self, row: dict[str, float]) -> bool:
        return all((row[f] > t) if above else (row[f] <= t) for f, above, t in self.conditions)

    def expression(self) -> Column:
        out = F.lit(True)
        for f, above, t in self.conditions:
            out = out & ((F.col(f) > F.lit(t)) if above else (F.col(f) <= F.lit(t)))
        return out


def _gain(p: int, n: int, p0: int, n0: int) -> float:
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else -1.0


def _grow(rows: list[tuple[dict, int]], most: int, least: int) -> Rule | None:
    """Conditions that gain most on the covered rows, until only bad rows are covered or nothing gains."""
    conditions: list[tuple[str, bool, float]] = []
    covered = rows
    while len(conditions) < most:
        p0, n0 = sum(1 for _, bad in covered if bad), sum(1 for _, bad in covered if not bad)
        if not p0 or not n0:
            break
        best: tuple[float, tuple[str, bool, float]] | None = None
        for f in FEATURES:
            order = sorted((x[f], bad) for x, bad in covered)
            p = n = 0
            for k, (v, bad) in enumerate(order[:-1]):
                p, n = p + bad, n + 1 - bad
                if v == order[k + 1][0]:
                    continue
                at = (v + order[k + 1][0]) / 2
                for above, a, b in ((False, p, n), (True, p0 - p, n0 - n)):
                    if a >= least and (g := _gain(a, b, p0, n0)) > 1e-9 and (best is None or g > best[0]):
                        best = (g, (f, above, at))
        if best is None:
            break
        conditions.append(best[1])
        covered = [r for r in covered if Rule((best[1],)).holds(r[0])]
    return Rule(tuple(conditions)) if conditions else None


def _worth(rule: Rule, rows: list[tuple[dict, int]]) -> tuple[float, int, int]:
    hit = [bad for x, bad in rows if rule.holds(x)]
    p, n = sum(hit), len(hit) - sum(hit)
    return ((p - n) / (p + n) if hit else -1.0, p, n)


def learn_rules(rows: list[tuple[dict, int]], most_rules: int = 12, most_conditions: int = 4, least: int = 8, precision: float = 0.9) -> list[Rule]:
    """Rules in order, from (statistics, 1 for bad) rows: two thirds grow, one third prunes and judges."""
    grow, prune = [r for i, r in enumerate(rows) if i % 3], [r for i, r in enumerate(rows) if not i % 3]
    out: list[Rule] = []
    while len(out) < most_rules and any(bad for _, bad in grow):
        rule = _grow(grow, most_conditions, least)
        if rule is None:
            break
        best, at = _worth(rule, prune), rule
        for k in range(len(rule.conditions) - 1, 0, -1):
            shorter = Rule(rule.conditions[:k])
            if (w := _worth(shorter, prune))[0] >= best[0]:
                best, at = w, shorter
        if best[1] < max(2, least // 3) or best[1] < precision * (best[1] + best[2]):
            break
        out.append(at)
        grow, prune = [r for r in grow if not at.holds(r[0])], [r for r in prune if not at.holds(r[0])]
    return out


def fit_rules(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[Rule]:
    """Rules from labels (doc_id, quality 0 or 1) over docs; of more than `sample` labelled rows those first by hash."""
    known = plain(labels, "doc_id", "quality").where("quality is not null and doc_id is not null")
    chosen = known.orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id").limit(sample)
    texts = plain(docs, "doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most `sample` ids
    rows = with_statistics(texts).select("doc_id", "quality", *FEATURES).orderBy(F.xxhash64("doc_id", F.lit(4)), "doc_id", *FEATURES).limit(2 * sample).collect()
    return learn_rules([({f: r[f] for f in FEATURES}, int(r.quality == 0)) for r in rows])


def verdict(rules: list[Rule]) -> Column:
    """One ordered expression: false by the first rule that holds, else true."""
    out = None
    for r in rules:
        out = F.when(r.expression(), F.lit(False)) if out is None else out.when(r.expression(), F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def judge(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """One row per row of docs: doc_id, the base counts, base_failed, kept."""
    df = with_statistics(plain(docs, "doc_id", "text"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return df.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & verdict(rules)).alias("kept"))
