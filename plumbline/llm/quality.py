"""Quality classifier by compression.

Two zstandard dictionaries are made from bounded samples of good and bad labelled text. A text is
compressed in blocks with either; the difference of the compressed sizes over the raw size is the
feature, and a logistic curve fitted on labelled documents that the dictionaries have not seen turns it
into a probability. Null and empty texts have the feature of an empty text and so a score like any other.
Repeated rows score alike, and so do texts that tie in size and difference. Long texts are compressed whole,
block by block. Without labels of both kinds the score is the share of label 1, or 0.5; an empty table gives an
empty result. Labels that are neither 0 nor 1 are ignored; of several for one doc_id the smallest counts. Columns
besides those named are ignored; one in `keep` that is named `score` stands before the result's.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, bounded_labels


@dataclass(frozen=True)
class QualityParams:
    block: int = 1024
    level: int = 3
    dict_bytes: int = 32 * 1024
    #: About so many labelled documents of each label make the dictionaries, as many others the calibration.
    fit_docs: int = 1500
    #: Longer documents aren't fitted on; shorter ones are fitted on whole.
    fit_chars: int = 12_000


@dataclass(frozen=True)
class QualityModel:
    params: QualityParams
    good: bytes
    bad: bytes
    #: Logistic weights of (1, difference, log2(1 + bytes) x difference).
    weights: tuple[float, float, float]


class _Pair:
    """The two compressors, made once for each worker and model."""

    def __init__(self, model_good: bytes, model_bad: bytes, params: QualityParams):
        self.block = params.block
        self.by = [zstandard.ZstdCompressor(level=params.level, dict_data=zstandard.ZstdCompressionDict(raw), write_content_size=False) for raw in (model_good, model_bad)]

    def difference(self, text: str | None) -> tuple[float, int]:
        raw = (text or "").encode("utf-8", "surrogatepass")
        good, bad = self.by
        total = 0
        for at in range(0, len(raw), self.block):
            piece = raw[at : at + self.block]
            total += len(bad.compress(piece)) - len(good.compress(piece))
        return total / max(1, len(raw)), len(raw)


def _features(diff: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.stack([np.ones(len(diff)), diff, diff * np.log2(1.0 + size)], axis=1)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Newton's method; standardised inside, weights returned for raw features (column 0 is the constant)."""
    mean, sd = x.mean(axis=0), x.std(axis=0)
    mean[0], sd[0] = 0.0, 1.0
    sd[sd == 0] = 1.0
    z, w = (x - mean) / sd, np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (p - y) / len(y) + ridge * w
        hess = (z * (p * (1 - p))[:, None]).T @ z / len(y) + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w = w - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    raw = w / sd
    raw[0] -= (w[1:] * mean[1:] / sd[1:]).sum()
    return raw


def _dictionary(texts: list[str], params: QualityParams) -> bytes:
    """A trained zstandard dictionary; raw content where there is too little to train on."""
    blocks = [raw[at : at + params.block] for raw in (t.encode("utf-8", "surrogatepass") for t in texts) for at in range(0, len(raw), params.block)]
    try:
        return zstandard.train_dictionary(params.dict_bytes, blocks).as_bytes()
    except zstandard.ZstdError:
        return (b"".join(blocks) + b" " * 64)[: params.dict_bytes]


def fit_quality(docs: DataFrame, labels: DataFrame, params: QualityParams = QualityParams(), *, text: str = "text", label: str = "quality") -> QualityModel:
    """Learn from the documents that labels (doc_id and a label of 0 or 1) name; the sample is bounded."""
    picked, counts = bounded_labels(labels, label, 2 * params.fit_docs)
    sample = docs.select("doc_id", F.col(text).alias("text")).where(F.length("text").between(1, params.fit_chars)).join(picked, "doc_id").select(label, "text")
    got = sorted({(int(r[0]), hash_order(r[1]), r[1]) for r in sample.collect()})
    share = np.mean([y for y, _, _ in got]) if got else 0.5
    if len({y for y, _, _ in got}) < 2:
        p = min(max(share, 1e-3), 1 - 1e-3)
        return QualityModel(params, b" " * 64, b" " * 64, (float(np.log(p / (1 - p))), 0.0, 0.0))
    halves = {y: ([t for z, _, t in got if z == y][0::2], [t for z, _, t in got if z == y][1::2]) for y in (0, 1)}
    good, bad = (_dictionary(halves[y][0], params) for y in (1, 0))
    pair = _Pair(good, bad, params)
    fresh = [(t, y) for y in (0, 1) for t in (halves[y][1] or halves[y][0])]
    found = np.array([pair.difference(t) for t, _ in fresh])
    y = np.array([y for _, y in fresh], float)
    # each label has its own share of the sample; weigh back to the shares of all labelled rows
    w = fit_logistic(_features(found[:, 0], found[:, 1]), y)
    here = max(1, (y == 1).sum()) / max(1, (y == 0).sum())
    w[0] += np.log((counts[1] / counts[0]) / here)
    return QualityModel(params, good, bad, tuple(float(v) for v in w))


def hash_order(text: str) -> int:
    """A fixed pseudo-random order of texts."""
    import xxhash

    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))


def score_quality(docs: DataFrame, model: QualityModel, *, keep: list[str], text: str = "text") -> DataFrame:
    """The columns `keep`, then score. Whole texts are compressed, block by block."""
    spark = docs.sparkSession
    attach(spark)
    shared = spark.sparkContext.broadcast(model)
    schema = docs.select(*keep).schema.add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        pair = _Pair(m.good, m.bad, m.params)
        for rb in batches:
            found = np.array([pair.difference(t) for t in rb.column(rb.num_columns - 1).to_pylist()]).reshape(-1, 2)
            score = 1 / (1 + np.exp(-np.clip(_features(found[:, 0], found[:, 1]) @ np.array(m.weights), -30, 30)))
            yield pa.RecordBatch.from_arrays([rb.column(i) for i in range(rb.num_columns - 1)] + [pa.array(score)], names=[f.name for f in schema.fields])

    return docs.select(*keep, F.col(text).alias("__text")).mapInArrow(run, schema)
