"""Substring dedup by content-defined chunking.

A gear rolling hash cuts each text into variable chunks whose ends depend on the last 32 bytes only, so an
insertion moves no cut but those beside it. Chunks are matched by 128-bit digest over the whole corpus; of
each, the occurrence with the smallest (doc_id, row key, offset) stays. In every other place a run of
matched neighbours of at least `least_run` bytes is removed. Cuts fall between code points, so what is kept
is valid text.

Nulls: a null text is empty; a null doc_id sorts first. Rows that repeat both id and text are one document:
they get equal results, and its first occurrence stays in each. Rows that share an id only are different
documents. Texts of any length are chunked whole. Empty tables give empty results; other columns are ignored
or carried: a carried column that is named like one of the results stands before it under the same name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytehash import BLOCK, gear_hashes
from .common import attach, discard, written
from .presence import sized_presence


@dataclass(frozen=True)
class ChunkParams:
    #: A cut is made where this many top bits of the rolling hash are zero.
    cut_bits: int = 5
    shortest: int = 16
    longest: int = 256
    least_run: int = 64
    #: The largest bitmap of repeated digests, in bits as a power of two.
    most_bits: int = 28


def _candidates(raw: bytes, params: ChunkParams) -> np.ndarray:
    """Ends of chunks the hash proposes, each between code points."""
    found = []
    limit = np.uint32(1 << (32 - params.cut_bits))
    for at in range(0, len(raw), BLOCK):
        back = min(at, 31)
        data = np.frombuffer(raw, np.uint8, min(BLOCK, len(raw) - at) + back, at - back)
        found.append(np.flatnonzero(gear_hashes(data)[back:] < limit) + at + 1)
    ends = np.concatenate(found) if found else np.zeros(0, np.int64)
    data = np.frombuffer(raw, np.uint8)
    inner = ends < len(raw)
    return ends[inner][(data[ends[inner]] & 0xC0) != 0x80]


def _select(ends: list[int], raw: bytes, params: ChunkParams) -> list[int]:
    """Chunk ends with the shortest and longest lengths kept; the last is the end of the text."""
    out, last = [], 0
    for end in [*ends, len(raw)]:
        while end - last > params.longest:
            cut = last + params.longest
            while raw[cut] & 0xC0 == 0x80 and cut > last + 1:
                cut -= 1
            out.append(cut)
            last = cut
        if end - last >= params.shortest or end == len(raw) > last:
            out.append(end)
            last = end
    return out


def chunk_ends(texts: list[bytes], params: ChunkParams) -> Iterator[list[int]]:
    """For each text the ends of its chunks. Small texts are hashed together with zeros between them."""
    at = 0
    while at < len(texts):
        stop, size = at, 0
        while stop < len(texts) and size + len(texts[stop]) <= BLOCK:
            size += len(texts[stop]) + 32
            stop += 1
        if stop == at:
            yield _select(_candidates(texts[at], params).tolist(), texts[at], params)
            at += 1
            continue
        joined = (b"\0" * 32).join(texts[at:stop]) + b"\0"
        starts = np.cumsum([0] + [len(t) + 32 for t in texts[at:stop]])
        data = np.frombuffer(joined, np.uint8)
        ends = np.flatnonzero(gear_hashes(data) < np.uint32(1 << (32 - params.cut_bits))) + 1
        ends = ends[ends < len(data)]
        ends = ends[(data[ends] & 0xC0) != 0x80]
        cuts = np.searchsorted(ends, starts)
        for i, raw in enumerate(texts[at:stop]):
            own = ends[cuts[i] : cuts[i + 1]] - starts[i]
            yield _select(own[(own > 0) & (own < len(raw))].tolist(), raw, params)
        at = stop


def _chunk_rows(batches: Iterator[pa.RecordBatch], params: ChunkParams, repeated=None) -> Iterator[pa.RecordBatch]:
    """(id, key, text) to rows of its chunks; with `repeated` only of those whose digest that filter may hold."""
    for rb in batches:
        ids, keys, texts = rb.column(0), rb.column(1), [(t or "").encode("utf-8", "surrogatepass") for t in rb.column(2).to_pylist()]
        rows, starts, sizes, digests = [], [], [], []

        def out():
            pair = np.frombuffer(b"".join(digests), ">u8").astype(np.uint64).view(np.int64).reshape(-1, 2)
            ok = slice(None) if repeated is None else np.flatnonzero(repeated.value.holds(pair[:, 0]))
            pick = pa.array(np.repeat(np.array([r for r, _ in rows], np.int64), [n for _, n in rows])[ok])
            at, size = np.array(starts, np.int32)[ok], np.array(sizes, np.int32)[ok]
            return pa.RecordBatch.from_arrays([ids.take(pick), keys.take(pick), pa.array(at), pa.array(size), pa.array(pair[ok, 0]), pa.array(pair[ok, 1])], names=["doc_id", "row_key", "at", "size", "d1", "d2"])

        for row, (raw, ends) in enumerate(zip(texts, chunk_ends(texts, params))):
            begun = 0
            for end in ends:
                digests.append(xxhash.xxh3_128_digest(raw[begun:end]))
                starts.append(begun)
                sizes.append(end - begun)
                begun = end
            rows.append((row, len(ends)))
            if len(starts) > 100_000:
                yield out()
                rows, starts, sizes, digests = [], [], [], []
        if starts:
            yield out()


def _digests_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rb in batches:
        yield pa.RecordBatch.from_arrays([rb.column(4)], names=["d1"])


def removed_runs(places: list[tuple[int, int]], least: int) -> list[tuple[int, int]]:
    """Merge matched chunks (start, size) into maximal runs (start, end) of at least `least` bytes."""
    runs: list[list[int]] = []
    for start, size in sorted(set(places)):
        if runs and start <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], start + size)
        else:
            runs.append([start, start + size])
    return [(a, b) for a, b in runs if b - a >= least]


def without(raw: bytes, runs: list[tuple[int, int]]) -> bytes:
    kept, at = [], 0
    for a, b in runs:
        kept.append(raw[at:a])
        at = b
    return b"".join([*kept, raw[at:]])


def row_keyed(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds __key, a 64-bit hash of id and text that tells apart documents which share an id."""
    return docs.withColumn("__key", F.xxhash64("doc_id", text))


def matched_chunks(docs: DataFrame, params: ChunkParams) -> DataFrame:
    """One row (doc_id, row_key, places) for each document with chunks that stand earlier in the corpus.

    First only half of each digest is counted; a bitmap of the repeated ones, sized by their number up to
    most_bits, then spares most other chunks the shuffle that finds first places. A full bitmap spares none.
    """
    attach(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = row_keyed(docs).select("doc_id", "__key", "text")
    halves = keyed.mapInArrow(lambda it: _digests_only(_chunk_rows(it, params)), "d1 long")
    repeated = written(halves.groupBy("d1").agg(F.count("*").alias("n")).where("n > 1").select("d1"), "digests")
    known = docs.sparkSession.sparkContext.broadcast(sized_presence(repeated, "d1", params.most_bits))
    chunks = written(keyed.mapInArrow(lambda it: _chunk_rows(it, params, known), f"doc_id {kind}, row_key long, at int, size int, d1 long, d2 long"), "chunks")
    known.destroy()
    discard(repeated)
    first = F.min(F.struct("doc_id", "row_key", "at")).alias("first")
    again = chunks.groupBy("d1", "d2").agg(first, F.count("*").alias("n")).where("n > 1").select("d1", "d2", "first")
    later = chunks.join(again, ["d1", "d2"]).where(~(F.struct("doc_id", "row_key", "at").eqNullSafe(F.col("first"))))
    # a document's places are no more than its chunks
    return later.groupBy("doc_id", "row_key").agg(F.collect_set(F.struct("at", "size")).alias("places"))


def dedup_chunks(docs: DataFrame, params: ChunkParams = ChunkParams(), *, carry: list[str] | None = None) -> DataFrame:
    """Columns doc_id and `carry`, then n_bytes, n_removed, n_spans and kept (the text that stays)."""
    carry = carry or []
    places = matched_chunks(docs, params).select(F.col("doc_id").alias("__id"), F.col("row_key").alias("__row"), "places")
    rows = row_keyed(docs).select("doc_id", *carry, "__key", F.col("text").alias("__text"))
    joined = rows.join(places, (F.col("__key") == F.col("__row")) & F.col("doc_id").eqNullSafe(F.col("__id")), "left").select("doc_id", *carry, "__text", "places")
    schema = docs.select("doc_id", *carry).schema.add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add("kept", "string").add("kept_sha256", "string")
    head = 1 + len(carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            out: list[tuple] = []
            for text, found in zip(rb.column(head), rb.column(head + 1)):
                raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
                runs = removed_runs([(p["at"], p["size"]) for p in found.as_py() or []], params.least_run)
                kept = without(raw, runs)
                out.append((len(raw), sum(b - a for a, b in runs), len(runs), kept.decode("utf-8", "replace"), hashlib.sha256(kept).hexdigest()))
            cols = list(zip(*out)) or [()] * 5
            made = [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([rb.column(i) for i in range(head)] + made, names=[f.name for f in schema.fields])

    return joined.mapInArrow(run, schema)
