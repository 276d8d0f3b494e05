"""Language identification: multinomial naive Bayes over hashed character n-grams.

The model is a matrix of log-probabilities, buckets by languages, which is broadcast. Its size is fixed by the
parameters (buckets x languages x 8 bytes); languages are counted first, and more than `most_langs` are refused.
Scoring is a sparse gather-and-sum in numpy over batches of texts.

Nulls: a null or letterless text is `und` with score 0; rows with a null text or language aren't learned from.
Ties go to the language first by code point. Repeated rows are scored alike. Texts of any length are scored
whole: long ones in pieces that carry over what the n-grams across a cut need. An empty table gives an empty
result; an empty training set gives `und` for all. Columns besides those named are ignored; one in `keep` that
is named like a result stands before it under the same name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, bounded_sample, text_batches

UNDETERMINED = "und"


@dataclass(frozen=True)
class LangParams:
    orders: tuple[int, ...] = (1, 2, 3)
    bucket_bits: int = 16
    smoothing: float = 0.1
    #: The fit uses about so many labelled documents of each language, no longer than fit_chars.
    fit_docs: int = 3000
    fit_chars: int = 20_000
    #: Tasks that count the fitting sample.
    fit_tasks: int = 6
    #: More languages than this would make the matrix too large to broadcast.
    most_langs: int = 500


@dataclass(frozen=True)
class LangModel:
    params: LangParams
    langs: tuple[str, ...]
    #: Log-probability of each n-gram bucket in each language.
    logp: np.ndarray
    prior: np.ndarray


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    table = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    table.setflags(write=False)
    return table


def _hashes(cps: np.ndarray, params: LangParams) -> Iterator[tuple[int, np.ndarray]]:
    """(n, bucket) of the n-grams from every place on, for each order."""
    shift, h = np.uint32(32 - params.bucket_bits), np.full(len(cps), 0x811C9DC5, np.uint32)
    for n in range(1, max(params.orders) + 1):
        if n > len(cps):
            break
        h = (h[: len(cps) - n + 1] ^ cps[n - 1 :]) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        if n in params.orders:
            yield n, ((h * np.uint32(0x85EBCA77)) >> shift).astype(np.intp)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _grams(batch: list[tuple[int, str]], params: LangParams) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """For each order (place in the batch, bucket) of every n-gram; and for each text whether it has a letter."""
    cps = _points("\0" + "\0".join(text.replace("\0", " ") for _, text in batch).lower() + "\0")
    edge = cps == 0
    letter = _letters()[cps]
    keep = letter | edge
    keep[1:] |= letter[:-1]
    cps, letter, edge = np.where(letter, cps, np.uint32(32))[keep], letter[keep], edge[keep]
    doc = np.cumsum(edge) - 1
    some = np.bincount(doc[letter], minlength=len(batch))[: len(batch)] > 0
    out = []
    for n, bucket in _hashes(cps, params):
        first = doc[: len(bucket)]
        ok = letter[: len(bucket)] if n == 1 else (doc[n - 2 : n - 2 + len(bucket)] == first) & (first < len(batch))
        out.append((first[ok], bucket[ok]))
    return out, some


#: Characters of a text that are hashed at once; what follows sees the n-grams across the cut.
PIECE = 1 << 18


def _is_long(batch: list[tuple[int, str]]) -> bool:
    return len(batch) == 1 and len(batch[0][1]) > PIECE


def _long_counts(text: str, params: LangParams) -> tuple[np.ndarray, bool]:
    """How often each bucket's n-grams stand in one long text, and whether it has a letter."""
    text = text.replace("\0", " ").lower()
    size = 1 << params.bucket_bits
    counts, some, after, carry = np.zeros(size, np.int64), False, False, np.full(1, 32, np.uint32)
    for at in range(0, len(text), PIECE):
        cps = _points(text[at : at + PIECE])
        letter = _letters()[cps]
        keep = letter.copy()
        keep[1:] |= letter[:-1]
        keep[:1] |= after
        after, some = bool(letter[-1]), some or bool(letter.any())
        edge = [np.full(1, 32, np.uint32)] if at + PIECE >= len(text) else []
        line = np.concatenate([carry, np.where(letter, cps, np.uint32(32))[keep], *edge])
        for n, bucket in _hashes(line, params):
            # n-grams of what was carried over alone have been counted
            fresh = np.arange(len(bucket)) >= (len(carry) - n + 1 if at else 0)
            if n == 1:
                fresh = _letters()[line] & (np.arange(len(line)) >= len(carry))
            counts += np.bincount(bucket[fresh], minlength=size)
        carry = line[max(0, len(line) - max(params.orders) + 1) :]
    return counts, some


def _count(batches: Iterator[pa.RecordBatch], params: LangParams) -> Iterator[pa.RecordBatch]:
    size = 1 << params.bucket_bits
    totals: dict[str, np.ndarray] = {}
    docs: dict[str, int] = {}
    for rb in batches:
        langs, texts = rb.column(0).to_pylist(), rb.column(1).to_pylist()
        for lang in langs:
            docs[lang] = docs.get(lang, 0) + 1
        for lang in sorted(set(langs)):
            sums = totals.setdefault(lang, np.zeros(size, np.int64))
            for batch in text_batches([t for t, x in zip(texts, langs) if x == lang], PIECE):
                if _is_long(batch):
                    sums += _long_counts(batch[0][1], params)[0]
                    continue
                for _, bucket in _grams(batch, params)[0]:
                    sums += np.bincount(bucket, minlength=size)
    for lang, sums in totals.items():
        yield pa.RecordBatch.from_pydict({"lang": [lang], "docs": pa.array([docs[lang]], pa.int64()), "counts": pa.array([sums.tobytes()], pa.binary())})


def fit_language(labelled: DataFrame, params: LangParams = LangParams(), *, text: str = "text", lang: str = "lang", key: str = "doc_id") -> LangModel:
    """Learn from rows with non-null text and language (few distinct languages)."""
    attach(labelled.sparkSession)
    rows = labelled.where(F.col(text).isNotNull() & F.col(lang).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(lang).count().limit(params.most_langs + 1).collect()}
    if len(counts) > params.most_langs:
        raise ValueError(f"more than {params.most_langs} languages")
    langs = tuple(sorted(counts))
    sample = bounded_sample(rows.select(key, lang, text), lang, key, params.fit_docs).where(F.length(text) <= params.fit_chars)
    parts = (
        sample.select(lang, text).repartition(params.fit_tasks)
        .mapInArrow(lambda it: _count(it, params), "lang string, docs long, counts binary")
        .collect()
    )
    size = 1 << params.bucket_bits
    table = np.zeros((size, len(langs)))
    for r in parts:
        table[:, langs.index(r["lang"])] += np.frombuffer(r["counts"], np.int64)
    logp = np.log(table + params.smoothing) - np.log(table.sum(axis=0) + params.smoothing * size)
    share = np.array([counts[x] for x in langs], float)
    return LangModel(params, langs, logp, np.log(share / share.sum()) if langs else share)


def score_texts(texts: list[str | None], model: LangModel) -> tuple[list[str], np.ndarray]:
    n, k = len(texts), len(model.langs)
    total, some = np.zeros((n, k)), np.zeros(n, bool)
    columns = [np.ascontiguousarray(model.logp[:, j], np.float32) for j in range(k)]
    for batch in text_batches([t or "" for t in texts], PIECE):
        rows = np.fromiter((r for r, _ in batch), np.int64, len(batch))
        if _is_long(batch):
            counts, some[rows[0]] = _long_counts(batch[0][1], model.params)
            total[rows[0]] += [float(counts @ c.astype(np.float64)) for c in columns]
            continue
        grams, has = _grams(batch, model.params)
        some[rows[has]] = True
        for piece, bucket in grams:
            starts = np.flatnonzero(np.diff(piece, prepend=-1))
            if len(starts):
                for j in range(k):
                    np.add.at(total[:, j], rows[piece[starts]], np.add.reduceat(np.take(columns[j], bucket), starts, dtype=np.float64))
    if not k:
        return [UNDETERMINED] * n, np.zeros(n)
    total += model.prior
    best = total.argmax(axis=1)
    score = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
    return [model.langs[b] if s else UNDETERMINED for b, s in zip(best, some)], np.where(some, score, 0.0)


def predict_language(docs: DataFrame, model: LangModel, *, keep: list[str], text: str = "text") -> DataFrame:
    """The columns `keep`, then lang_pred and score. Nothing but the text reaches the prediction; where `keep` names
    the text itself, it is sent once."""
    spark = docs.sparkSession
    attach(spark)
    shared = spark.sparkContext.broadcast(model)
    schema = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double")
    sent = keep if text in keep else [*keep, text]
    at, names = sent.index(text), [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            lang, score = score_texts(rb.column(at).to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays([rb.column(i) for i in range(len(keep))] + [pa.array(lang, pa.string()), pa.array(score)], names=names)

    return docs.select(*sent).mapInArrow(run, schema)
