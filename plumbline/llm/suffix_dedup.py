"""Exact substring dedup with suffix arrays over shards.

Every byte is removed that is covered by a string of `length` bytes which also starts anywhere else. Texts are
bytes in UTF-8; strings never cross documents; what counts is the input, not what is left of it.

1. Anchors. Of every window of `length` bytes the `gram` bytes with the smallest hash (the last of equals) are
   its anchor: equal windows have equal anchors at equal places. All windows with one anchor lie within a
   segment around it. Segments that are equal as a whole are covered, without any sorting.
2. The windows of the remaining segments lie left or right of their anchor, and so contain a known half of the
   segment's core. Only segments whose half stands in another segment too can hold repeated windows. Their
   windows are cut into parts by where they start; all windows of a part contain a core, and only what stands
   before and after it tells them apart. Equal stretches of a part are covered as they are.
3. The stretches that only share a core are dealt to shards by it, with the core as one symbol. A shard sorts
   its suffixes (Larsson-Sadakane), takes common prefixes (Kasai) and marks those of a whole window. Cores with
   more stretches than a shard holds are dealt over several shards; the sorted window digests of these are
   merged by binary search.

Equal means equal 128-bit digests for segments, cores and margins, and equal symbols within a shard.

Nulls: a null text is empty. Rows that repeat are separate documents and cover one another; rows that share
id and text get equal results. Texts shorter than `length` keep everything. Empty tables give empty results.
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
from .chunk_dedup import row_keyed, without
from .common import attach, written
from .presence import sized_presence
from .suffix import common_prefixes, suffix_array


@dataclass(frozen=True)
class SuffixParams:
    length: int = 400
    #: Bytes whose hash makes an anchor: what the gear hash covers.
    gram: int = 32
    #: Of the places one in 2 ** sparse_bits is looked at for anchors first.
    sparse_bits: int = 4
    #: Symbols of collapsed stretches in one shard; more of one core are dealt over several shards.
    shard_bytes: int = 512 << 10
    #: The largest bitmap of repeated keys, in bits as a power of two.
    most_bits: int = 28

    @property
    def reach(self) -> int:
        """Furthest start of a window before its anchor."""
        return self.length - self.gram

    @property
    def half(self) -> int:
        return self.reach // 2


def _anchors(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, p: SuffixParams) -> np.ndarray:
    """Anchors (ascending) of the windows that lie within one of the stretches begins..ends of the bytes.

    Places whose hash is low are looked at first: the smallest of a window is among them if it has any. Stretches
    with a window that has none are looked at whole.
    """
    fits = ends - begins >= p.length
    begins, ends = begins[fits], ends[fits]
    if not len(begins):
        return np.zeros(0, np.int64)
    h = gear_hashes(data)[p.gram - 1 :]  # of the gram that begins at each place
    at = np.flatnonzero(h < np.uint32(1 << (32 - p.sparse_bits)))
    own = np.searchsorted(begins, at, side="right") - 1
    inside = (own >= 0) & (at <= ends[own] - p.gram)
    at, own = at[inside], own[inside]
    # a gap of more than `reach` places without one
    edges = np.concatenate([at, begins - 1, ends - p.gram + 1])
    edges.sort()
    wide = edges[:-1][np.diff(edges) > p.reach + 1]
    bare = np.unique(np.searchsorted(begins, wide + 1, side="right") - 1)
    bare = bare[(bare >= 0)]
    if len(bare):
        every = np.concatenate([np.arange(begins[i], ends[i] - p.gram + 1) for i in bare.tolist()])
        at = np.concatenate([at[~np.isin(own, bare)], every])
        at.sort()
        own = np.searchsorted(begins, at, side="right") - 1
    value, n = h[at], len(at)
    low, high = np.maximum(begins[own] - 1, at - p.reach - 1), np.minimum(ends[own] - p.gram + 1, at + p.reach + 1)
    # nearest place to the left with a smaller hash, to the right with one as small: the last of equals counts
    for side, bound in ((-1, low), (1, high)):
        open_, step = np.arange(n), side
        while len(open_):
            other = open_ + step
            ok = (other >= 0) & (other < n)
            open_, other = open_[ok], other[ok]
            ok = (at[other] - bound[open_]) * side < 0
            open_, other = open_[ok], other[ok]
            found = value[other] < value[open_] if side < 0 else value[other] <= value[open_]
            bound[open_[found]] = at[other[found]]
            open_, step = open_[~found], step + side
    return at[high - low - 2 >= p.reach]


def anchored(texts: list[bytes], p: SuffixParams) -> Iterator[tuple[int, bytes, np.ndarray]]:
    """(row, bytes, anchors) of each text with windows."""
    step, at = BLOCK // 2, 0
    while at < len(texts):
        if len(texts[at]) > step:
            raw, parts = texts[at], []
            # each block gives the anchors of the windows that begin in it
            for s in range(0, max(1, len(raw) - p.length + 1), step):
                hi = min(len(raw), s + step + p.length - 1)
                parts.append(_anchors(np.frombuffer(raw, np.uint8, hi - s, s), np.array([0]), np.array([hi - s]), p) + s)
            yield at, raw, np.unique(np.concatenate(parts))
            at += 1
            continue
        stop, size = at, 0
        while stop < len(texts) and len(texts[stop]) <= step and size + len(texts[stop]) <= BLOCK:
            size += len(texts[stop])
            stop += 1
        bounds = np.cumsum([0] + [len(t) for t in texts[at:stop]])
        found = _anchors(np.frombuffer(b"".join(texts[at:stop]), np.uint8), bounds[:-1], bounds[1:], p)
        cuts = np.searchsorted(found, bounds)
        for i in np.flatnonzero(np.diff(cuts)).tolist():
            yield at + i, texts[at + i], found[cuts[i] : cuts[i + 1]] - bounds[i]
        at = stop


def _longs(digests: list[bytes]) -> np.ndarray:
    """128-bit digests as rows of two longs."""
    return np.frombuffer(b"".join(digests), ">u8").astype(np.uint64).view(np.int64).reshape(-1, 2)


def _segments(raw: bytes, anchors: list[int], p: SuffixParams) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Digests of each anchor's segment (with the anchor's place in it), and the segments."""
    spans = [(max(0, a - p.reach), min(len(raw), a + p.length)) for a in anchors]
    return _longs([xxhash.xxh3_128_digest(raw[lo:hi], seed=a - lo) for a, (lo, hi) in zip(anchors, spans)]), spans


def _halves(raw: bytes, anchors: list[int], p: SuffixParams) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the core's left and right half; 0 where the text ends before."""
    core = p.gram + p.half
    left = [xxhash.xxh3_64_intdigest(raw[a - p.half : a + p.gram]) | 1 if a >= p.half else 0 for a in anchors]
    right = [xxhash.xxh3_64_intdigest(raw[a : a + core], seed=1) | 1 if a + core <= len(raw) else 0 for a in anchors]
    return np.array(left, np.uint64).view(np.int64), np.array(right, np.uint64).view(np.int64)


def _encoded(column: pa.Array) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in column.to_pylist()]


def _key_rows(batches, p):
    """Of each segment (0, digest, 0), and (1, half, 0, digest in short) for either half of its core: which segments
    are repeated as a whole, which halves stand in different segments?"""
    for rb in batches:
        kinds, k1, k2, marks, held = [], [], [], [], 0

        def out():
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(kinds)), *(pa.array(np.concatenate(c)) for c in (k1, k2, marks))], names=["kind", "k1", "k2", "mark"])

        for _, raw, anchors in anchored(_encoded(rb.column(2)), p):
            anchors = anchors.tolist()
            pair, _ = _segments(raw, anchors, p)
            half = np.concatenate(_halves(raw, anchors, p))
            n, ok = len(anchors), half != 0
            kinds.append(np.concatenate([np.zeros(n, np.int8), np.ones(int(ok.sum()), np.int8)]))
            k1.append(np.concatenate([pair[:, 0], half[ok]]))
            k2.append(np.concatenate([pair[:, 1], np.zeros(int(ok.sum()), np.int64)]))
            marks.append(np.concatenate([np.zeros(n, np.int64), np.concatenate([pair[:, 0] ^ pair[:, 1]] * 2)[ok]]))
            held += 3 * n
            if held > 100_000:
                yield out()
                kinds, k1, k2, marks, held = [], [], [], [], 0
        if held:
            yield out()


def _parts(p: SuffixParams, left: bool) -> list[tuple[int, int]]:
    """Four ranges of how far a window starts before its anchor, of one side."""
    lo, hi = (p.half, p.reach + 1) if left else (0, p.half)
    cuts = [lo + (hi - lo) * i // 4 for i in range(5)]
    return list(zip(cuts[:-1], cuts[1:]))


def _found_rows(batches, repeated, mixed, p):
    """Segments that may be repeated as a whole (c1 null); and of anchors whose half is in several segments one row
    for each part: the digest (c1, c2) of the core that all windows of the part contain, what the part's windows
    cover before and after that core, and a digest (d1, d2) of these margins.

    Of segments that may be repeated as a whole a task gives the parts once: the others are covered anyway.
    """
    sides = [(side, *r) for side in (0, 1) for r in _parts(p, side == 0)]
    seen: set[tuple[int, int]] = set()
    for rb in batches:
        ids, rk = rb.column(0), rb.column(1)
        place, spans, cores, digests, margins = [], [], [], [], []

        def out():
            pick = pa.array(np.array(place))
            none = pa.array(np.array([c is None for c in cores]))
            core, both = _longs([c or bytes(16) for c in cores]), _longs(digests)
            lo, hi = np.array(spans, np.int64).T
            return pa.RecordBatch.from_arrays(
                [ids.take(pick), rk.take(pick), pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(lo), pa.array(hi), pa.array(core[:, 0], mask=none.to_numpy(zero_copy_only=False)), pa.array(core[:, 1]), pa.array([m and m[0] for m in margins], pa.binary()), pa.array([m and m[1] for m in margins], pa.binary()), pa.array([m and m[2] for m in margins], pa.int32())],
                names=["doc_id", "rk", "d1", "d2", "lo", "hi", "c1", "c2", "before", "after", "width"],
            )

        for row, raw, anchors in anchored(_encoded(rb.column(2)), p):
            anchors = anchors.tolist()
            pair, whole = _segments(raw, anchors, p)
            likely = repeated.value.holds(pair[:, 0])
            fresh = ~likely
            for i in np.flatnonzero(likely).tolist():
                place.append(row)
                spans.append(whole[i])
                cores.append(None)
                digests.append(pair[i].astype(">i8").tobytes())
                margins.append(None)
                name = (int(pair[i, 0]), int(pair[i, 1]))
                if name not in seen:
                    seen.add(name)
                    fresh[i] = True
            near = [(key != 0) & mixed.value.holds(key) & fresh for key in _halves(raw, anchors, p)]
            for name, (side, o0, o1) in enumerate(sides):
                for i in np.flatnonzero(near[side]).tolist():
                    a = anchors[i]
                    first, last = max(0, a - o1 + 1), min(a - o0, len(raw) - p.length)
                    if last < first:
                        continue
                    begin, end = a - o0, a - o1 + 1 + p.length
                    before, after = raw[first:begin], raw[end : last + p.length]
                    place.append(row)
                    spans.append((first, last + p.length))
                    cores.append(xxhash.xxh3_128_digest(raw[begin:end], seed=name))
                    digests.append(xxhash.xxh3_128_digest(before + after, seed=len(before)))
                    margins.append((before, after, o1 - o0))
            if len(place) > 20_000:
                yield out()
                place, spans, cores, digests, margins = [], [], [], [], []
        if place:
            yield out()


def runs_of(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes that windows of `length` at the given starts cover."""
    starts = np.unique(starts)
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > length)
    return [(int(a), int(b) + length) for a, b in zip(starts[np.append(0, cut + 1)], starts[np.append(cut, len(starts) - 1)])]


def _collapsed(core: np.ndarray, before: list[bytes], after: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The stretches as one line of symbols, each with one symbol for its core and an end; their begins and lengths."""
    head, tail = (np.fromiter(map(len, x), np.int64, len(x)) for x in (before, after))
    lengths = head + tail + 2
    begins = np.cumsum(lengths) - lengths
    symbols = np.empty(int(lengths.sum()), np.int64)
    for start, pieces, size in ((begins, before, head), (begins + head + 1, after, tail)):
        at = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())
        symbols[at] = np.frombuffer(b"".join(pieces), np.uint8)
    symbols[begins + head] = 257 + core
    symbols[begins + lengths - 1] = 256
    return symbols, begins, lengths


def repeated_in_shard(core: np.ndarray, before: list[bytes], after: list[bytes], width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(stretch, place) of every window that stands twice among the stretches.

    Stretches with equal cores (numbers from 0) are told apart by what stands before and after: a window is `width`
    symbols of the collapsed stretch, its core among them.
    """
    symbols, begins, lengths = _collapsed(core, before, after)
    depth = int(width.max())
    sa, place, rank = suffix_array(symbols, depth)
    # only suffixes of a whole window and more can share one, so the walk ends with a stretch's last window
    windows = lengths - width
    lcp = common_prefixes(symbols, sa, place, rank, begins, windows, depth)
    after_ = np.append(lcp[sa[1:]], 0)[place] if len(sa) else lcp
    stretch = np.repeat(np.arange(len(begins)), windows)
    at = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    spot = begins[stretch] + at
    ok = np.maximum(lcp[spot], after_[spot]) >= width[stretch]
    return stretch[ok], at[ok]


def _shard(table: pa.Table, p: SuffixParams, merge: bool) -> pa.Table:
    """Spans of windows that stand twice in the shard; with `merge` also the digests (w1, w2) of all."""
    lo, width = (table.column(c).to_numpy() for c in ("lo", "width"))
    before, after = (table.column(c).to_pylist() for c in ("before", "after"))
    pair = np.stack([table.column("c1").to_numpy(), table.column("c2").to_numpy()], axis=1)
    _, core = np.unique(pair, axis=0, return_inverse=True)
    stretch, at = repeated_in_shard(core.ravel(), before, after, width.astype(np.int64))
    first = np.flatnonzero(np.diff(stretch, prepend=-1))
    # windows of a part overlap, so those of one stretch cover one run
    row, start = stretch[first], lo[stretch[first]] + at[first]
    stop = lo[row] + (np.maximum.reduceat(at, first) if len(first) else at) + p.length
    w = np.zeros((len(row), 2), np.int64)
    none = np.ones(len(row), bool)
    if merge:
        # those repeated here too: another shard's window may repeat one of them
        rows, places, digests = [], [], []
        for i, (x, y) in enumerate(zip(before, after)):
            name = pair[i].tobytes()
            for t in range(len(x) + len(y) + 2 - int(width[i])):
                rows.append(i)
                places.append(t)
                digests.append(xxhash.xxh3_128_digest(name + x[t:] + y[: int(width[i]) - 1 - len(x) + t], seed=len(x) - t))
        rows, places = np.array(rows, np.int64), np.array(places, np.int64)
        row, start, stop = np.concatenate([row, rows]), np.concatenate([start, lo[rows] + places]), np.concatenate([stop, lo[rows] + places + p.length])
        w, none = np.concatenate([w, _longs(digests)]), np.concatenate([none, np.zeros(len(rows), bool)])
    pick = pa.array(row)
    ids = [table.column(c).combine_chunks().take(pick) for c in ("doc_id", "rk")]
    return pa.table([*ids, pa.array(start), pa.array(stop), pa.array(w[:, 0], mask=none), pa.array(w[:, 1], mask=none)], names=["doc_id", "rk", "lo", "hi", "w1", "w2"])


def _merge_shards(table: pa.Table) -> pa.Table:
    """Windows whose digest another shard of the same half has too: each shard's sorted digests are searched
    in the sorted digests of all."""
    pair = np.stack([table.column("w1").to_numpy(), table.column("w2").to_numpy()], axis=1)
    digest = np.ascontiguousarray(pair).view([("a", np.int64), ("b", np.int64)]).ravel()
    where = table.select(["doc_id", "rk", "lo"]).to_pylist()
    spot = np.array([xxhash.xxh3_64_intdigest(repr((w["doc_id"], w["rk"], w["lo"])).encode()) for w in where], np.uint64)
    # a window is one place, however many segments and shards brought it
    _, once = np.unique(spot, return_index=True)
    every = np.sort(digest[once], order=["a", "b"])
    first, last = np.searchsorted(every, digest, side="left"), np.searchsorted(every, digest, side="right")
    return table.filter(pa.array(last - first > 1)).select(["doc_id", "rk", "lo", "hi"])


def _only(wanted):
    """Keeps rows whose second column the filter may hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            yield rb.filter(pa.array(wanted.value.holds(rb.column(1).to_numpy())))

    return run


def repeated_spans(docs: DataFrame, p: SuffixParams) -> DataFrame:
    """(doc_id, rk, lo, hi): stretches to remove, overlapping ones included."""
    spark = docs.sparkSession
    attach(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    spans_type = f"doc_id {kind}, rk long, lo long, hi long, w1 long, w2 long"
    keyed = row_keyed(docs.where(F.length("text") > 0)).select("doc_id", F.col("__key").alias("rk"), "text")
    keys = keyed.mapInArrow(lambda it: _key_rows(it, p), "kind byte, k1 long, k2 long, mark long")
    keys = keys.groupBy("kind", "k1", "k2").agg(F.count("*").alias("n"), F.min("mark").alias("a"), F.max("mark").alias("b"))
    keys = written(keys.where("case when kind = 0 then n > 1 else a <> b end").select("kind", "k1", "k2"), "keys")
    repeated, mixed = keys.where("kind = 0").select(F.col("k1").alias("d1"), F.col("k2").alias("d2")), keys.where("kind = 1").select(F.col("k1").alias("half"))
    has_repeat = spark.sparkContext.broadcast(sized_presence(repeated, "d1", p.most_bits))
    has_half = spark.sparkContext.broadcast(sized_presence(mixed, "half", p.most_bits))
    found = keyed.mapInArrow(lambda it: _found_rows(it, has_repeat, has_half, p), f"doc_id {kind}, rk long, d1 long, d2 long, lo long, hi long, c1 long, c2 long, before binary, after binary, width int")
    found = written(found, "found")
    has_repeat.destroy()
    has_half.destroy()
    spot = ["doc_id", "rk", "lo", "hi"]
    whole = found.where("c1 is null").select(*spot, "d1", "d2").join(repeated, ["d1", "d2"]).where(F.col("hi") - F.col("lo") >= p.length).select(*spot)

    # equal stretches are covered as they are; of cores with a single one each different stretch is searched
    parts = found.where("c1 is not null")
    kinds = written(parts.groupBy("c1", "c2", "d1", "d2").agg(F.count("*").alias("n")), "kinds")
    again = parts.select(*spot, "c1", "c2", "d1", "d2").join(kinds.where("n > 1").select("c1", "c2", "d1", "d2"), ["c1", "c2", "d1", "d2"]).select(*spot)
    open_ = kinds.groupBy("c1", "c2").agg(F.count("*").alias("k"), F.min("n").alias("least")).where("k > 1 and least = 1").select("c1", "c2", "k")
    one = F.min(F.struct(*spot, "before", "after", "width")).alias("s")
    stretch = parts.join(open_, ["c1", "c2"]).groupBy("c1", "c2", "d1", "d2", "k").agg(one).select("c1", "c2", "k", "s.*")
    stretch = written(stretch, "stretches")
    # a core's stretches are all of about twice its part's width
    most = max(2, p.shard_bytes // (p.half // 2))
    shards = max(1, -(-stretch.count() // (most // 2)))
    small = stretch.where(F.col("k") <= most).groupBy(F.pmod(F.xxhash64("c1", "c2"), F.lit(shards)).alias("shard"))
    spans = small.applyInArrow(lambda t: _shard(t, p, False), spans_type).select("doc_id", "rk", "lo", "hi")
    large = stretch.where(F.col("k") > most)
    if not large.isEmpty():
        dealt = large.groupBy("c1", "c2", F.pmod(F.xxhash64("doc_id", "rk"), F.ceil(F.col("k") / most)).alias("part"))
        dealt = written(dealt.applyInArrow(lambda t: _shard(t, p, True), spans_type), "dealt")
        spans = spans.unionAll(dealt.where("w1 is null").select("doc_id", "rk", "lo", "hi"))
        ranges = max(1, -(-dealt.count() // 100_000))
        spans = spans.unionAll(dealt.where("w1 is not null").groupBy(F.pmod("w2", F.lit(ranges)).alias("range")).applyInArrow(_merge_shards, f"doc_id {kind}, rk long, lo long, hi long"))
    return whole.unionAll(again).unionAll(spans)


def merged_runs(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


_RESULT = "n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string"


def _results(batches: Iterator[pa.RecordBatch], skip) -> Iterator[pa.RecordBatch]:
    """Rows (id, key, text[, spans]) to results; without spans those rows that `skip` doesn't hold."""
    for rb in batches:
        if skip is not None:
            rb = rb.filter(pa.array(~skip.value.holds(rb.column(1).to_numpy())))
        out = []
        spans = rb.column(3).to_pylist() if skip is None else [None] * rb.num_rows
        for text, found in zip(rb.column(2), spans):
            raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
            runs = merged_runs([(s["lo"], s["hi"]) for s in found or []])
            kept = without(raw, runs)
            out.append((len(raw), sum(b - a for a, b in runs), len(runs), kept, hashlib.sha256(kept).hexdigest()))
        cols = list(zip(*out)) or [()] * 5
        made = [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()))]
        yield pa.RecordBatch.from_arrays([rb.column(0), *made], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])


def remove_repeats(docs: DataFrame, params: SuffixParams = SuffixParams()) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes) and their SHA-256."""
    spark = docs.sparkSession
    p = params
    kind = docs.schema["doc_id"].dataType.simpleString()
    spans = repeated_spans(docs, p).groupBy("doc_id", "rk").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))
    spans = written(spans, "spans")
    touched = spark.sparkContext.broadcast(sized_presence(spans, "rk", p.most_bits))
    keyed = row_keyed(docs).select("doc_id", F.col("__key").alias("rk"), "text")
    schema = f"doc_id {kind}, {_RESULT}"
    clean = keyed.mapInArrow(lambda it: _results(it, touched), schema)

    some = keyed.mapInArrow(_only(touched), keyed.schema)
    spans = spans.select(F.col("doc_id").alias("id2"), F.col("rk").alias("rk2"), "spans")
    met = some.join(spans, (F.col("rk") == F.col("rk2")) & F.col("doc_id").eqNullSafe(F.col("id2")), "left").select("doc_id", "rk", "text", "spans")
    return clean.unionAll(met.mapInArrow(lambda it: _results(it, None), schema))
