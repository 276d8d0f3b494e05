"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features are the hashed character n-grams present in a text (presence, not counts). Each is scaled by
the log ratio of its smoothed document frequencies in toxic and other labelled text; a logistic
classifier with an L2 penalty is then fitted on the scaled features. The model is one array of fixed
size (2 ** bucket_bits floats), broadcast. Null and empty texts get the score of a text without features.
Repeated rows score alike, and so do texts with the same n-grams. Texts of any length count each n-gram once.
Without both labels the score is near 1 where only label 1 occurs and near 0 otherwise; an empty table gives an
empty result. Labels that are neither 0 nor 1 are ignored; of several for one doc_id the smallest counts. Columns
besides those named are ignored; one in `keep` that is named `score` stands before the result's.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, bounded_labels, overlapping, text_batches


@dataclass(frozen=True)
class ToxicParams:
    orders: tuple[int, ...] = (4, 5, 6)
    bucket_bits: int = 20
    smoothing: float = 1.0
    penalty: float = 3e-4
    rounds: int = 80
    #: About so many labelled documents of each label are fitted on, no longer than fit_chars.
    fit_docs: int = 1200
    fit_chars: int = 8_000
    fit_tasks: int = 6
    #: Buckets in fewer fitting documents get no weight.
    least_docs: int = 4
    #: Buckets whose log-count ratio is smaller than this in size tell nothing and get no weight.
    least_ratio: float = 0.25


@dataclass(frozen=True)
class ToxicModel:
    params: ToxicParams
    #: Weight of each bucket, log-count ratio included.
    weights: np.ndarray
    bias: float


_SPACE = re.compile(r"\s+")


def folded(text: str | None) -> str:
    """Lower case, white space and NUL folded to single spaces, a space at either end."""
    return f" {_SPACE.sub(' ', (text or '').lower().replace(chr(0), ' ')).strip()} "


def _buckets(batch: list[tuple[int, str]], params: ToxicParams) -> tuple[np.ndarray, np.ndarray]:
    """(place in the batch, bucket) of every n-gram of folded texts; repeats included."""
    joined = "\0".join(text for _, text in batch)
    cps = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    doc = np.cumsum(cps == 0)
    shift, pieces, found = np.uint32(32 - params.bucket_bits), [], []
    h = np.full(len(cps), 0x811C9DC5, np.uint32)
    for n in range(1, max(params.orders) + 1):
        if n > len(cps):
            break
        h = (h[: len(cps) - n + 1] ^ cps[n - 1 :]) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        if n in params.orders:
            ok = (doc[: len(h)] == doc[n - 1 :]) & (cps[: len(h)] != 0)
            pieces.append(doc[: len(h)][ok])
            found.append(((h[ok] * np.uint32(0x85EBCA77)) >> shift).astype(np.int64))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(pieces), np.concatenate(found)


def features(texts: list[str | None], params: ToxicParams) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Batches of (row, bucket) with each bucket of a row once. A long text is hashed in overlapping pieces, whose
    buckets are gathered first."""
    size = 1 << params.bucket_bits
    for batch in text_batches([folded(t) for t in texts], PIECE):
        if len(batch) == 1 and len(batch[0][1]) > PIECE:
            held = np.zeros(size, bool)
            for piece in overlapping(batch[0][1], max(params.orders) - 1, PIECE):
                held[_buckets([(0, piece)], params)[1]] = True
            bucket = np.flatnonzero(held)
            yield np.full(len(bucket), batch[0][0]), bucket
            continue
        place, bucket = _buckets(batch, params)
        rows = np.fromiter((r for r, _ in batch), np.int64, len(batch))
        code = (place << params.bucket_bits) | bucket
        code.sort()
        code = code[np.flatnonzero(np.diff(code, prepend=-1))] if len(code) else code
        yield rows[code >> params.bucket_bits], code & (size - 1)


#: Characters that are hashed at once.
PIECE = 1 << 18


def _present(batches: Iterator[pa.RecordBatch], params: ToxicParams) -> Iterator[pa.RecordBatch]:
    for rb in batches:
        label, texts = rb.column(0).to_pylist(), rb.column(1).to_pylist()
        for at in range(0, len(texts), 200):
            part = texts[at : at + 200]
            rows, buckets = zip(*features(part, params)) if part else ((), ())
            rows, buckets = np.concatenate(rows), np.concatenate(buckets)
            sets = [np.unique(buckets[rows == i]).astype(np.int32).tobytes() for i in range(len(part))]
            yield pa.RecordBatch.from_pydict({"label": pa.array(label[at : at + 200], pa.int32()), "buckets": pa.array(sets, pa.binary())})


def fit_linear(sets: list[np.ndarray], y: np.ndarray, params: ToxicParams) -> tuple[np.ndarray, float]:
    """Log-count ratios, then logistic regression on the scaled presence features by accelerated gradient steps."""
    size = 1 << params.bucket_bits
    counts = [np.full(size, params.smoothing) for _ in (0, 1)]
    for s, k in zip(sets, y):
        counts[int(k)][s] += 1  # a set holds a bucket once
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    seen = np.flatnonzero((counts[0] + counts[1] >= 2 * params.smoothing + params.least_docs) & (np.abs(ratio) >= params.least_ratio))
    slot = np.full(size, -1, np.int32)
    slot[seen] = np.arange(len(seen))
    picked = []
    for s in sets:
        p = slot[s]
        picked.append(p[p >= 0])
    starts = np.concatenate([[0], np.cumsum([len(p) for p in picked])])
    cols = np.concatenate(picked) if picked else np.zeros(0, np.int32)
    del picked
    rows = np.repeat(np.arange(len(sets), dtype=np.int32), np.diff(starts))
    r = ratio[seen]
    norm = np.sqrt(np.bincount(rows, r[cols] ** 2, len(sets)).mean()) or 1.0
    r = r / norm
    value = r[cols].astype(np.float32)
    balance = np.where(y == 1, len(y) / (2 * max(1, (y == 1).sum())), len(y) / (2 * max(1, (y == 0).sum())))
    w, ahead, b, b_ahead, t = np.zeros(len(seen)), np.zeros(len(seen)), 0.0, 0.0, 1.0
    rate = 1.0
    for _ in range(params.rounds):
        z = np.bincount(rows, value * ahead[cols], len(sets)) + b_ahead
        g = balance * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)
        new = ahead - rate * (np.bincount(cols, value * g[rows], len(seen)) + params.penalty * ahead)
        b_new, t_new = b_ahead - rate * g.sum(), (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, b_ahead = new + (t - 1) / t_new * (new - w), b_new + (t - 1) / t_new * (b_new - b)
        w, b, t = new, b_new, t_new
    weights = np.zeros(size, np.float32)
    weights[seen] = w * r
    return weights, float(b)


def fit_toxicity(docs: DataFrame, labels: DataFrame, params: ToxicParams = ToxicParams(), *, text: str = "text", label: str = "toxic") -> ToxicModel:
    """Learn from the documents that labels (doc_id and a label of 0 or 1) name; the sample is bounded."""
    attach(docs.sparkSession)
    picked, counts = bounded_labels(labels, label, params.fit_docs)
    size = 1 << params.bucket_bits
    if len(counts) < 2:
        return ToxicModel(params, np.zeros(size, np.float32), 30.0 if 1 in counts else -30.0)
    sample = docs.select("doc_id", F.col(text).alias("text")).where(F.length("text").between(1, params.fit_chars)).join(picked, "doc_id")
    got = sample.select(label, "text").repartition(params.fit_tasks).mapInArrow(lambda it: _present(it, params), "label int, buckets binary").collect()
    got = sorted((r[0], bytes(r[1])) for r in got)
    y = np.array([k for k, _ in got], float)
    weights, bias = fit_linear([np.frombuffer(s, np.int32) for _, s in got], y, params)
    return ToxicModel(params, weights, bias)


def score_batch(texts: list[str | None], model: ToxicModel) -> np.ndarray:
    """Probabilities from the buckets that each whole text holds."""
    total = np.full(len(texts), model.bias)
    for rows, buckets in features(texts, model.params):
        total += np.bincount(rows, model.weights[buckets], len(texts))
    return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def score_toxicity(docs: DataFrame, model: ToxicModel, *, keep: list[str], text: str = "text") -> DataFrame:
    """The columns `keep`, then score."""
    spark = docs.sparkSession
    attach(spark)
    shared = spark.sparkContext.broadcast(model)
    schema = docs.select(*keep).schema.add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            score = score_batch(rb.column(rb.num_columns - 1).to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays([rb.column(i) for i in range(rb.num_columns - 1)] + [pa.array(score)], names=[f.name for f in schema.fields])

    return docs.select(*keep, F.col(text).alias("__text")).mapInArrow(run, schema)
