"""Toxicity: a linear classifier of character n-grams whose features are scaled by naive Bayes log-count ratios.

A text, in lower case with a space at both ends, has the hashed n-grams of its characters (code points), each once. From labelled
texts, an n-gram's ratio is the log of how much more often toxic texts have it than others (smoothed); logistic
regression with a penalty is then trained on ratios instead of ones. N-grams that too few texts have, or whose ratio is small,
don't count. Whole texts are scored, whatever their length; null counts as empty and scores what the intercept and that length give.
Rows are scored one by one, so repeated rows score alike. Empty tables give no rows; without labels no text is toxic. Other
columns are carried or ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_by_bytes, numbered, place, plain, trimmed

SIZES = (4, 5, 6)
BUCKETS = 1 << 20
#: Labelled texts that a fit sees at most, those first by hash; and bytes of theirs in one block of counting.
SAMPLE, BLOCK = 5000, 600_000


def ngrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Text numbers and buckets, both by occurrence, of all n-grams of whole texts (not yet each once)."""
    low = pc.utf8_lower(pc.fill_null(texts, "").cast(pa.large_string()))
    low = pc.binary_join_element_wise(pa.scalar("", pa.large_string()), low, pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string()))
    bounds = np.frombuffer(low.buffers()[1], np.int64)[low.offset : low.offset + len(low) + 1]
    whole = bytes(low.buffers()[2])[bounds[0] : bounds[-1]] if len(low) else b""
    raw = np.frombuffer(whole.decode().encode("utf-32-le"), np.uint32)
    length = pc.utf8_length(low).to_numpy()
    ends = np.cumsum(length)
    doc = np.repeat(np.arange(len(low)), length)
    left = ends[doc] - np.arange(len(raw)) if len(raw) else np.zeros(0, np.int64)
    rolled, docs, found = raw.astype(np.uint64) + np.uint64(1), [], []
    for n in range(2, max(SIZES) + 1):
        rolled = rolled[:-1] * np.uint64(0x100000001B3) + raw[n - 1 :] + np.uint64(1) if len(raw) >= n else rolled[:0]
        if n in SIZES:
            inside = left[: len(rolled)] >= n
            x = rolled[inside] * np.uint64(0x9E3779B97F4A7C15)
            found.append((x >> np.uint64(44)).astype(np.int64))
            docs.append(doc[: len(rolled)][inside])
    return np.concatenate(docs), np.concatenate(found)


def counted(doc: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text's buckets once: text number, bucket, and the log of one more than its count."""
    key, n = np.unique(doc * BUCKETS + bucket, return_counts=True)
    return key // BUCKETS, key % BUCKETS, np.log2(1.0 + n)


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # a bucket's weight times its ratio; 0 where it doesn't count
    intercept: float
    per_length: float = 0.0  # weight of the log of the text's length

    def score(self, texts: pa.Array) -> np.ndarray:
        doc, bucket = ngrams(texts)
        some = self.weights[bucket] != 0
        d, b, x = counted(doc[some], bucket[some])
        sums = np.bincount(d, x * self.weights[b], len(texts))
        return 1 / (1 + np.exp(-np.clip(sums + self.intercept + self.per_length * _log_length(texts), -30, 30)))


def _log_length(texts: pa.Array) -> np.ndarray:
    n = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    return (np.log2(1.0 + n) - 11) / 2


def fit(texts: pa.Array, toxic: np.ndarray, evidence: float = 24.0, penalty: float = 3e-5, rounds: int = 400) -> Model:
    """Buckets count whose 2 x 2 table with the label has a log-likelihood statistic of `evidence` or more.

    Without both labels among the texts, a model that gives their share to all; without any, that takes all for clean.
    """
    y = np.asarray(toxic, float)
    n1, n0 = y.sum(), (1 - y).sum()
    if not n1 or not n0:
        return Model(np.zeros(BUCKETS), float(np.log((n1 + 0.5) / (n0 + 1.5))))
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))

    def blocks():
        """Texts by BLOCK bytes: the first one's number, and the n-grams of a block, not yet each once."""
        begin = 0
        while begin < len(texts):
            end = max(begin + 1, int(np.searchsorted(sizes, (sizes[begin - 1] if begin else 0) + BLOCK, side="right")))
            yield begin, *ngrams(texts.slice(begin, end - begin))
            begin = end

    counts, weighed = np.zeros((2, BUCKETS)), np.zeros((2, BUCKETS))
    for begin, d, b in blocks():
        d, b, x = counted(d, b)
        for c in (0, 1):
            own = y[d + begin] == c
            counts[c] += np.bincount(b[own], minlength=BUCKETS)
            weighed[c] += np.bincount(b[own], x[own], minlength=BUCKETS)
    ratio = np.log((weighed[1] + 1) / (n1 + 2)) - np.log((weighed[0] + 1) / (n0 + 2))
    chosen = _likelihood(counts[1], n1, counts[0], n0) >= evidence
    # Read again, so that only the chosen buckets are ever held for all texts.
    parts = []
    for begin, d, b in blocks():
        d, b, x = counted(d[chosen[b]], b[chosen[b]])
        parts.append((d + begin, b, x))
    d, b, x = (np.concatenate(p) for p in zip(*parts))
    x *= ratio[b]
    length = _log_length(texts)
    # Rare toxic texts weigh as much as all others together, half way.
    weight = np.where(y == 1, np.sqrt(n0 / n1), 1.0)
    weight /= weight.sum()
    scale = 1 / np.sqrt(max(np.bincount(d, x * x, len(y)).mean(), 1e-9))
    x *= scale
    w, rest = np.zeros(BUCKETS), np.zeros(2)  # rest: intercept and the length's weight
    m, v, mr, vr = np.zeros(BUCKETS), np.zeros(BUCKETS), np.zeros(2), np.zeros(2)
    for t in range(1, rounds + 1):
        z = np.bincount(d, x * w[b], len(y)) + rest[0] + rest[1] * length
        g = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        gw = np.bincount(b, x * g[d], BUCKETS) + penalty * w
        gr = np.array([g.sum(), (g * length).sum()])
        m, v, mr, vr = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw * gw, 0.9 * mr + 0.1 * gr, 0.99 * vr + 0.01 * gr * gr
        rate = 0.1 / (1 + t / 100)
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8) * chosen
        rest -= rate * (mr / (1 - 0.9**t)) / (np.sqrt(vr / (1 - 0.99**t)) + 1e-8)
    return Model(w * ratio * scale * chosen, float(rest[0]), float(rest[1]))


def _likelihood(a: np.ndarray, n1: float, b: np.ndarray, n0: float) -> np.ndarray:
    """Twice the log-likelihood ratio of a of n1 against b of n0."""
    share = (a + b) / (n1 + n0)

    def part(x, n):
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.nan_to_num(x * np.log(x / (n * share))) + np.nan_to_num((n - x) * np.log((n - x) / (n * (1 - share))))

    return 2 * (part(a, n1) + part(b, n0))


def held_out(doc_id: str = "doc_id"):
    """Every fifth document by the CRC-32 of its id as text; a null id is of none of the learning rows."""
    return F.coalesce(F.crc32(F.col(f"`{doc_id}`").cast("string").cast("binary")) % 5 == 0, F.lit(True))


def fit_documents(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from the labelled rows that aren't held out; of more than `sample` those first by hash. Rows without a label (null) are passed over."""
    known = plain(labels, "doc_id", "toxic").where(F.col("toxic").isNotNull() & ~held_out())
    chosen = known.orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id").limit(sample)
    # Rows that repeat a labelled doc_id count once; a dropped one has the same label and, as doc_ids name documents, the same text.
    rows = plain(docs, "doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).orderBy(F.xxhash64("doc_id", F.lit(6)), "doc_id")
    got = rows.select("text", "toxic").toArrow()
    return fit(got["text"].combine_chunks(), got["toxic"].to_numpy())


def with_score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with `score` (0 to 1) behind its columns, from the text alone; docs has no other column of that name."""
    sent = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.intercept, model.per_length))  # 4 MB at any size

    def run(batches):
        own = Model(*sent.value)
        for big in batches:
            for batch in batches_by_bytes(big, text, 500_000):
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.score(batch[text]), pa.float64())], names=[*batch.schema.names, "score"])
        trimmed()

    return docs.mapInArrow(run, docs.withColumn("score", F.lit(0.0)).schema)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted."""
    scored = with_score(plain(docs, "doc_id", "text"), fit_documents(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """docs without the rows whose score reaches the threshold; all columns as they were."""
    scored = with_score(numbered(docs), fit_documents(docs, labels), place(docs, "text"))
    return scored.where(F.col("score") < threshold).drop("score").toDF(*docs.columns)
