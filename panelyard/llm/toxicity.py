"""Operator 10: a linear classifier on character n-grams, scaled by naive Bayes log-count ratios.

Features are the hashed n-grams of a text's distinct words, present or not.
Each is scaled by the logarithm of its smoothed share among toxic texts over
that among the others, counted over all labelled training texts. A logistic
regression on the scaled features, divided by the square root of their number,
is fitted on a bounded sample of the labelled training texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, is_small, saved, table, unused

BUCKET_BITS = 18
BUCKETS = 1 << BUCKET_BITS
SIZES = (3, 5, 7)
#: The regression is fitted on about so many labelled texts; the log-count ratios take all of them.
SAMPLE_TEXTS = 6_000
STEPS = 80
SEGMENT = 500
BROADCAST_LABELS = 500_000
#: Factors of the rolling and the final hash of an n-gram's code points.
ROLL, STIR = np.uint32(0x01000193), np.uint32(0x9E3779B1)

_last = np.zeros(BUCKETS, np.int32)  # where each bucket was written last, in this Python worker


def features(text: str | bytes | None) -> np.ndarray:
    """The buckets of the character n-grams of all words of a text, once each (A-Z lower-cased; no words: none).

    The distinct words stand side by side, each between two marks; n-grams are hashed for all places at once, and those
    that reach into another word are left out.
    """
    body = text.encode() if isinstance(text, str) else bytes(text or b"")
    words = dict.fromkeys(body.lower().split())
    if not words:
        return np.empty(0, np.int32)
    s = (b"\x02" + b"\x03\x02".join(words) + b"\x03").decode("utf-8", "replace")
    c = np.frombuffer(s.encode("utf-32-le"), "<u4")
    word, h, found = np.cumsum(c == 2), c, []
    for n in range(2, min(max(SIZES), len(c)) + 1):
        h = h[:-1] * ROLL + c[n - 1 :]
        if n in SIZES:
            x = (h[word[: len(h)] == word[n - 1 :]] + np.uint32(n)) * STIR
            found.append((x ^ (x >> np.uint32(15))) * STIR >> np.uint32(32 - BUCKET_BITS))
    f = np.concatenate(found).astype(np.int32) if found else np.empty(0, np.int32)
    places = np.arange(len(f), dtype=np.int32)
    _last[f] = places
    return f[_last[f] == places]


def log_count_ratios(counts: pd.DataFrame) -> np.ndarray:
    """counts (bucket, toxic, other): log of the ratio of smoothed shares, by bucket."""
    p, q = np.ones(BUCKETS), np.ones(BUCKETS)
    b = counts["bucket"].to_numpy()
    p[b] += counts["toxic"].to_numpy()
    q[b] += counts["other"].to_numpy()
    return np.log((p / p.sum()) / (q / q.sum())).astype(np.float32)


def fit(texts: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Weights by bucket and, last, the intercept: full-batch descent with moment estimates, in segments of texts.

    Both labels weigh the same in all, however rare one is.
    """
    w, n = np.zeros(BUCKETS, np.float32), len(y)
    base = float(np.log((y.sum() + 1) / (n - y.sum() + 1)))
    if not n or not 0 < y.sum() < n:
        return np.append(w, np.float32(base))
    parts, base, weight = [], 0.0, np.where(y > 0, 0.5 / y.sum(), 0.5 / (n - y.sum()))
    for a in range(0, n, SEGMENT):
        few = texts[a : a + SEGMENT]
        size = np.array([len(t) for t in few])
        parts.append((np.concatenate(few), np.repeat(np.arange(len(few), dtype=np.int32), size), (1 / np.sqrt(np.maximum(size, 1))).astype(np.float32)))
    m, v, mb, vb = np.zeros(BUCKETS), np.zeros(BUCKETS), 0.0, 0.0
    for step in range(1, steps + 1):
        grad, g0 = np.zeros(BUCKETS), 0.0
        wr = w * ratio
        for k, (f, d, scale) in enumerate(parts):
            yk = y[k * SEGMENT : k * SEGMENT + len(scale)]
            z = np.bincount(d, weights=wr[f], minlength=len(scale)) * scale + base
            e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - yk) * weight[k * SEGMENT : k * SEGMENT + len(scale)]
            grad += np.bincount(f, weights=(e * scale)[d], minlength=BUCKETS)
            g0 += e.sum()
        grad = grad * ratio + 1e-5 * w
        rate = 0.3 * (1 - step / (steps + 10))
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        mb, vb = 0.9 * mb + 0.1 * g0, 0.99 * vb + 0.01 * g0 * g0
        w = w - (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)).astype(np.float32)
        base -= rate * (mb / (1 - 0.9**step)) / (np.sqrt(vb / (1 - 0.99**step)) + 1e-9)
    return np.append(w * ratio, np.float32(base))


def train(docs: DataFrame, labels: DataFrame, sample_texts: int = SAMPLE_TEXTS) -> np.ndarray:
    """The model (weights by bucket, intercept) from docs (doc_id, text) and labels (doc_id, toxic 0 or 1).

    Null labels and ids take no part. A text with several label rows counts once with each of them, so that conflicting
    labels weigh against each other. Without texts of both labels the score is the smoothed share of toxic ones, a half
    where there are none. The sample is chosen by a hash of the id, so reruns agree. Other columns are ignored.
    """
    labels = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic in (0, 1)")
    joined = docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(F.broadcast(labels) if is_small(labels, BROADCAST_LABELS) else labels.hint("merge"), "doc_id")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, BUCKETS), np.int64)
        for b in batches:
            for t, y in zip(b.column(0), b.column(1)):
                sums[y.as_py(), features(t.as_py())] += 1
        for at in range(0, BUCKETS, 1 << 14):
            s = sums[:, at : at + (1 << 14)]
            i = np.flatnonzero(s.any(axis=0))
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array((i + at).astype(np.int32)), pa.array(s[1, i]), pa.array(s[0, i])], names=["bucket", "toxic", "other"])

    counts = joined.select("text", "toxic").mapInArrow(count, "bucket int, toxic long, other long")
    counts = counts.groupBy("bucket").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other")).toPandas()  # BUCKETS rows at most
    ratio = log_count_ratios(counts)
    n = labels.count()
    share = min(1.0, sample_texts / max(n, 1))
    chosen = joined.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([features(t.as_py()).tobytes() for t in b.column(1)], pa.binary())], names=["doc_id", "toxic", "f"])

    chosen = saved(chosen.select("doc_id", "text", "toxic").mapInArrow(featured, "doc_id long, toxic int, f binary"), "toxic-sample")

    def fitted(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "toxic"]).reset_index(drop=True)
        model = fit([np.frombuffer(f, np.int32) for f in pdf["f"]], pdf["toxic"].to_numpy(np.float64), ratio)
        return pd.DataFrame({"model": [model.astype("<f4").tobytes()]})

    got = chosen.withColumn("all", F.lit("all")).groupBy("all").applyInPandas(fitted, "model binary").first()
    return np.frombuffer(bytes(got[0]), "<f4") if got else np.append(np.zeros(BUCKETS, np.float32), np.float32(0))


def scored(docs: DataFrame, model: np.ndarray, text: str = "text") -> DataFrame:
    """docs without the text, and score: the probability that the text is toxic.

    Null and blank texts get the model's base rate. Texts of any length are read whole; repeated rows get equal scores.
    Other columns stay, whatever their names; columns named score or predicted are replaced. An empty table gives an empty
    result.
    """
    others = [c for c in docs.columns if c not in (text, "score", "predicted")]
    schema = docs.select(*others).withColumn("score", F.lit(0.0)).schema
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, base = shared.value[:-1], float(shared.value[-1])
        for b in batches:
            z = []
            for t in b.column(len(others)):
                f = features(t.as_py())
                z.append(float(w[f].sum(dtype=np.float64)) / max(len(f), 1) ** 0.5 + base)
            s = 1 / (1 + np.exp(-np.clip(np.array(z, np.float64), -500, 500)))
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(len(others))] + [pa.array(s)], names=[*others, "score"])

    return docs.select(*others, F.col(text).cast("binary").alias(unused("t", others))).mapInArrow(run, schema)


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(docs.filter(crc_mod("doc_id", 5) != 0), labels.filter(crc_mod("doc_id", 5) != 0))
    out = scored(docs.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "text"), model)
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
