"""Exact n-gram Jaccard self-join with vertical partitioning.

N-grams are 64-bit hashes; "equal" below means equal hashes.

1. Open texts. N-grams in the lower part of the hash range (`zone`) are counted over all documents. A text in
   which more than a quarter of all its n-grams stand nowhere else can't link; only the others stay open. Their
   sets are written once, and no text is read again.
2. Candidates. Open texts that are equal as sets form a class with its smallest id as representative. Over the
   representatives the global order of n-grams is exact: by how many hold one, then by hash. Two sets that link
   share an n-gram in the first quarter of either, so rare n-grams meet first.
3. Every set is cut into fragments of the hash range; the overlap of a candidate pair is counted in each fragment
   separately and summed per pair. First each representative is counted against its best star, a holder of an
   n-gram of its prefix; in a second round those still outside against a star of the largest group they meet.
   Texts with at least `near` percent in common with their star form groups.
4. Pairs within a group of three or more are all counted in cells of two blocks of texts, fragment by fragment,
   by matrix products over the n-grams that both blocks hold: no row is made for a pair. Pairs across groups
   meet on the n-grams of their prefixes and are counted like the stars.

So every link between different texts is verified; a group of m near copies has up to m * (m - 1) / 2 of them,
and the arithmetic grows as they do, not the rows. How texts are grouped only decides which way counts a pair.

Nulls: a null text has no n-grams and links with nothing. A null doc_id gets no component of its own (null)
and takes part in no link. Rows that repeat an id count as that one document: their links add up. Columns
besides doc_id and text are ignored, whatever their names. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytehash import shingles, word_hashes
from .common import attach, discard, written
from .components import components
from .presence import sized_presence


@dataclass(frozen=True)
class JoinParams:
    width: int = 5
    #: Two documents link when 100 * intersection >= percent * union.
    percent: int = 75
    #: A power of two.
    fragments: int = 4
    #: Share of the hash range whose n-grams are counted over all texts.
    zone: float = 0.4
    #: The largest bitmap of repeated n-grams, in bits as a power of two; a full one only leaves more texts open.
    most_bits: int = 28
    #: Texts with this percentage in common with their star are in one group.
    near: int = 40
    #: Texts, and n-grams, of a block of a group whose pairs are all counted; a cell holds two blocks.
    block_texts: int = 2048
    block_grams: int = 1_000_000


def _prefix_length(n, p: JoinParams):
    """How many n-grams, first in the order, hold one of any set that links; for numbers and arrays."""
    return n - (n * p.percent + 99) // 100 + 1


def _in_zone(h: np.ndarray, p: JoinParams) -> np.ndarray:
    """Of sorted hashes those in the counted zone."""
    return h[: np.searchsorted(h, np.uint64(int(p.zone * 2.0**64)))]


def _zone_rows(batches: Iterator[pa.RecordBatch], p: JoinParams) -> Iterator[pa.RecordBatch]:
    for rb in batches:
        found, held = [], 0
        for _, words in word_hashes(rb.column(0).to_pylist()):
            found.append(_in_zone(shingles(words, p.width), p))
            held += len(found[-1])
            if held > 200_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], names=["gram"])
                found, held = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], names=["gram"])


def _set_rows(batches: Iterator[pa.RecordBatch], repeated, p: JoinParams) -> Iterator[pa.RecordBatch]:
    """doc_id, set size, 128-bit digest of the set; of open texts also the set."""
    for rb in batches:
        ids, rows, sizes, digests, sets, held = rb.column(0), [], [], [], [], 0

        def out():
            pair = np.frombuffer(b"".join(digests), ">u8").astype(np.uint64).view(np.int64).reshape(-1, 2)
            ends = np.cumsum([0] + [0 if s is None else len(s) for s in sets])
            flat = np.concatenate([s for s in sets if s is not None] or [np.zeros(0, np.uint64)])
            closed = pa.array([s is None for s in sets], pa.bool_())
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.view(np.int64)), mask=closed)
            return pa.RecordBatch.from_arrays([ids.take(pa.array(rows)), pa.array(sizes, pa.int64()), pa.array(pair[:, 0]), pa.array(pair[:, 1]), pc.invert(closed), lists], names=["doc_id", "n", "d1", "d2", "open", "grams"])

        for row, words in word_hashes(rb.column(1).to_pylist()):
            h = shingles(words, p.width)
            zone = _in_zone(h, p)
            alone = len(zone) - int(np.count_nonzero(repeated.value.holds(zone.view(np.int64))))
            rows.append(row)
            sizes.append(len(h))
            digests.append(xxhash.xxh3_128_digest(h.tobytes()))
            sets.append(h if len(h) and alone < _prefix_length(len(h), p) else None)
            held += 8 if sets[-1] is None else len(h)
            if held > 200_000:
                yield out()
                rows, sizes, digests, sets, held = [], [], [], [], 0
        if rows:
            yield out()


def _cut(batches: Iterator[pa.RecordBatch], p: JoinParams) -> Iterator[pa.RecordBatch]:
    """(x, grams) to (x, fragment, its n-grams packed and sorted)."""
    shift = np.uint64(64 - (p.fragments - 1).bit_length())
    for rb in batches:
        xs, fragments, packed = [], [], []
        for x, grams in zip(rb.column(0).to_pylist(), rb.column(1)):
            h = grams.values.to_numpy().view(np.uint64)
            cuts = np.searchsorted(h >> shift if p.fragments > 1 else h * np.uint64(0), np.arange(p.fragments + 1, dtype=np.uint64))
            for f, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())):
                if a < b:
                    xs.append(x)
                    fragments.append(f)
                    packed.append(h[a:b].tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(xs, pa.int64()), pa.array(fragments, pa.int32()), pa.array(packed, pa.binary())], names=["x", "fragment", "grams"])


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rb in batches:
        n = [len(np.intersect1d(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), assume_unique=True)) for x, y in zip(rb.column(2), rb.column(3))]
        yield pa.RecordBatch.from_arrays([rb.column(0), rb.column(1), pa.array(n, pa.int64())], names=["a", "b", "n"])


def _counted(pairs: DataFrame, pieces: DataFrame) -> DataFrame:
    """(a, b, na, nb) with `both`, the overlap: partial ones by fragment, summed per pair. Pairs without any go."""
    right = pieces.select(F.col("x").alias("b"), "fragment", F.col("grams").alias("gb"))
    left = pieces.select(F.col("x").alias("a"), "fragment", F.col("grams").alias("ga"))
    met = pairs.select("a", "b").join(right, "b").join(left, ["a", "fragment"]).select("a", "b", "ga", "gb")
    summed = met.mapInArrow(_overlaps, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("both"))
    return pairs.join(summed, ["a", "b"])


def _alike(percent: int) -> Column:
    return F.col("both") * (100 + percent) >= (F.col("na") + F.col("nb")) * percent


def _met(flat: np.ndarray, row: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Overlaps of the texts `left` with the texts `right`; entry e says that text row[e] holds n-gram flat[e]."""
    place_l, place_r = (np.full(max(row.max(initial=0), left.max(initial=0), right.max(initial=0)) + 1, -1) for _ in range(2))
    place_l[left], place_r[right] = np.arange(len(left)), np.arange(len(right))
    _, col = np.unique(flat, return_inverse=True)
    in_l, in_r = place_l[row] >= 0, place_r[row] >= 0
    held_l, held_r = (np.bincount(col[x], minlength=col.max(initial=0) + 1) for x in (in_l, in_r))
    out = np.zeros((len(left), len(right)), np.int32)
    # n-grams of many pairs as matrix products, those of few pair by pair
    many = held_l * held_r > 2048
    wide = np.flatnonzero(many)
    slot = np.full(len(many), -1)
    slot[wide] = np.arange(len(wide))
    for at in range(0, len(wide), 1024):
        ml, mr = (np.zeros((len(x), min(1024, len(wide) - at)), np.float32) for x in (left, right))
        here = (slot[col] >= at) & (slot[col] < at + 1024)
        for m, place, own in ((ml, place_l, in_l), (mr, place_r, in_r)):
            e = np.flatnonzero(here & own)
            m[place[row[e]], slot[col[e]] - at] = 1
        for k in range(0, len(left), 512):
            out[k : k + 512] += (ml[k : k + 512] @ mr.T).astype(np.int32)
    el, er = (np.flatnonzero(~many[col] & own) for own in (in_l & (held_r[col] > 0), in_r & (held_l[col] > 0)))
    er = er[np.argsort(col[er], kind="stable")]
    few = np.where(~many & (held_l > 0), held_r, 0)
    begin, times = np.cumsum(few) - few, held_r[col[el]]
    cuts = np.searchsorted(np.cumsum(times), np.arange(0, times.sum() + 1_000_000, 1_000_000))
    for a, b in zip(cuts, [*cuts[1:], len(el)]):
        t = times[a:b]
        step = np.arange(t.sum()) - np.repeat(np.cumsum(t) - t, t)
        other = er[np.repeat(begin[col[el[a:b]]], t) + step]
        np.add.at(out.reshape(-1), np.repeat(place_l[row[el[a:b]]], t) * len(right) + place_r[row[other]], 1)
    return out


def _linked(table: pa.Table, p: JoinParams) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a cell (x, n, own, low, high, grams) the texts of its two blocks, and places (i, j) of those that link."""
    order = np.argsort(table.column("x").to_numpy(), kind="stable")
    x, n, own = (table.column(c).to_numpy()[order] for c in ("x", "n", "own"))
    low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
    left, right = np.flatnonzero(own == low), np.flatnonzero(own == high)
    if not len(left) or not len(right):
        return x[left], x[right], np.zeros(0, np.int64), np.zeros(0, np.int64)
    lists = table.column("grams").combine_chunks()
    offsets = lists.offsets.to_numpy()
    flat, row = lists.values.to_numpy()[offsets[0] : offsets[-1]].view(np.uint64), np.empty(len(order), np.int64)
    row[order] = np.arange(len(order))
    row = np.repeat(row, np.diff(offsets))
    fragment = (flat >> np.uint64(64 - (p.fragments - 1).bit_length())).astype(np.int64) if p.fragments > 1 else np.zeros(len(flat), np.int64)
    both = np.zeros((len(left), len(right)), np.int32)
    for f in range(p.fragments):
        here = np.flatnonzero(fragment == f)
        both += _met(flat[here], row[here], left, right)
    found_i, found_j = [], []
    for k in range(0, len(left), 512):
        ok = both[k : k + 512].astype(np.int64) * (100 + p.percent) >= (n[left[k : k + 512], None] + n[right]) * p.percent
        i, j = np.nonzero(ok)
        keep = i + k < j if low == high else np.ones(len(i), bool)
        found_i.append((i[keep] + k).astype(np.int32))
        found_j.append(j[keep].astype(np.int32))
    return x[left], x[right], np.concatenate(found_i), np.concatenate(found_j)


def _count_cell(table: pa.Table, p: JoinParams) -> pa.Table:
    """x, k links in this cell, and the smallest text that its links in this cell reach; texts without links go."""
    left, right, i, j = _linked(table, p)
    x, at = np.unique(np.concatenate([left, right]), return_inverse=True)
    i, j = at[i], at[len(left) + j]  # x ascends, so the smallest place is the smallest text
    k = np.bincount(i, minlength=len(x)) + np.bincount(j, minlength=len(x))
    low, ends, other = np.arange(len(x)), np.concatenate([i, j]), np.concatenate([j, i])
    order = np.argsort(ends, kind="stable")
    ends, other = ends[order], other[order]
    first = np.flatnonzero(np.diff(ends, prepend=-1))
    while len(ends):
        after = low.copy()
        after[ends[first]] = np.minimum(low[ends[first]], np.minimum.reduceat(low[other], first))
        after = after[after]
        if (after == low).all():
            break
        low = after
    some = k > 0
    return pa.table({"x": x[some], "k": k[some], "low": x[low[some]]})


def _pairs_cell(table: pa.Table, p: JoinParams) -> pa.Table:
    left, right, i, j = _linked(table, p)
    return pa.table({"a": np.minimum(left[i], right[j]), "b": np.maximum(left[i], right[j])})


@dataclass(frozen=True)
class Joined:
    """The join's parts. x names a text: the id, or where an id repeats a hash of id and set; rep names the
    texts that are equal as sets, by the smallest x."""

    params: JoinParams
    #: doc_id, n of every row.
    summary: DataFrame
    #: x, doc_id, rep of every open text.
    classes: DataFrame
    repeats: bool
    #: Verified links (a, b) outside the groups whose pairs are all counted in cells.
    apart: DataFrame
    #: c, low, high, own, x, n, grams: the cells; a text stands in each cell of its block.
    cells: DataFrame

    def pairs(self) -> DataFrame:
        """Every link (a, b), a < b, between representatives, once."""
        p = self.params
        inside = self.cells.groupBy("c", "low", "high").applyInArrow(lambda t: _pairs_cell(t, p), "a long, b long")
        return self.apart.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).unionAll(inside)

    def counted(self) -> DataFrame:
        """x, k, low: rows whose k sum up to the number of other representatives that x links with, and whose
        links (x, low) reach as far as all links do."""
        p = self.params
        inside = self.cells.groupBy("c", "low", "high").applyInArrow(lambda t: _count_cell(t, p), "x long, k long, low long")
        low = F.least("a", "b").alias("low")
        ends = self.apart.select(F.explode(F.array("a", "b")).alias("x"), F.lit(1).cast("long").alias("k"), low)
        return ends.unionAll(inside)


def _open_sets(docs: DataFrame, p: JoinParams) -> DataFrame:
    """doc_id, n, d1, d2 and `open` of every row, and the sets of open ones."""
    spark = docs.sparkSession
    grams = docs.select("text").mapInArrow(lambda it: _zone_rows(it, p), "gram long")
    repeated = written(grams.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram"), "repeated")
    known = spark.sparkContext.broadcast(sized_presence(repeated, "gram", p.most_bits))
    rows = written(docs.mapInArrow(lambda it: _set_rows(it, known, p), "doc_id long, n long, d1 long, d2 long, open boolean, grams array<long>"), "sets")
    known.destroy()
    discard(repeated)
    return rows


def _prefixes(reps: DataFrame, p: JoinParams) -> DataFrame:
    """(gram, h) of every n-gram of a prefix that another set holds too; h is x, its size, the n-grams before this
    one in the order that some other set holds (`before`), those after it (`rest`) and after the prefix (`past`)."""
    held = reps.select("x", "n", F.explode("grams").alias("gram"))
    many = held.groupBy("gram").agg(F.count("*").alias("c")).where("c > 1")
    mine = held.join(many, "gram").groupBy("x", "n").agg(F.sort_array(F.collect_list(F.struct("c", "gram"))).alias("s"))
    # n-grams that no other set holds come first in the order
    alone = F.col("n") - F.size("s")
    length = F.col("n") - F.expr(f"(n * {p.percent} + 99) div 100") + 1
    mine = mine.where(length > alone).select("x", "n", alone.alias("alone"), length.alias("length"), F.slice("s", F.lit(1), (length - alone).cast("int")).alias("s"))
    rows = mine.select("x", "n", "alone", "length", F.posexplode("s").alias("at", "g"))
    return rows.select(F.col("g.gram").alias("gram"), F.struct("x", F.col("n").alias("nx"), F.col("at").cast("long").alias("before"), (F.col("n") - F.col("alone") - F.col("at") - 1).alias("rest"), (F.col("n") - F.col("length")).alias("past")).alias("h"))


def _meeting(l: str, r: str, p: JoinParams) -> tuple[Column, Column]:
    """Of rows (l, r) that share an n-gram: whether it may bring them together, and how many n-grams of theirs at
    most come after the prefix of one of them.

    Of two sets that link the smaller one (by size, then x) shares more of its own: for it a shorter prefix will
    do. Before the n-gram they share no more than either has in common with any set at all, after it no more than
    either has."""
    least_shared = lambda n: F.ceil(F.col(n) * (2 * p.percent) / (100 + p.percent)).cast("long")
    smaller = F.struct(f"{l}.nx", f"{l}.x") < F.struct(f"{r}.nx", f"{r}.x")
    past = [F.when(less, least_shared(f"{k}.nx") - 1).otherwise(F.col(f"{k}.past")) for k, less in ((l, smaller), (r, ~smaller))]
    alike = F.least(f"{l}.nx", f"{r}.nx") * 100 >= F.greatest(f"{l}.nx", f"{r}.nx") * p.percent
    most = F.least(f"{l}.before", f"{r}.before") + 1 + F.least(f"{l}.rest", f"{r}.rest")
    enough = most * (100 + p.percent) >= (F.col(f"{l}.nx") + F.col(f"{r}.nx")) * p.percent
    return alike & enough & (F.col(f"{l}.rest") >= past[0]) & (F.col(f"{r}.rest") >= past[1]), F.greatest(*past)


def _possible(met: DataFrame, p: JoinParams) -> DataFrame:
    """From rows (l, r) that share an n-gram, the pairs whose sizes and places leave room for enough overlap.

    All that two sets share comes at or after the first n-gram that met, in both. What they share besides those
    that met comes after the last of these in both, and after the prefix of one of them."""
    meets, past = _meeting("l", "r", p)
    both = met.where(meets).groupBy(F.col("l.x").alias("a"), F.col("r.x").alias("b"), F.col("l.nx").alias("na"), F.col("r.nx").alias("nb"), past.alias("past"))
    both = both.agg(F.count("*").alias("hits"), F.least(F.min("l.rest"), F.min("r.rest")).alias("rest"), F.least(F.max("l.rest"), F.max("r.rest")).alias("room"))
    return both.where(F.least(F.col("room") + 1, F.col("hits") + F.least("rest", "past")) * (100 + p.percent) >= (F.col("na") + F.col("nb")) * p.percent)


def similarity_join(docs: DataFrame, params: JoinParams = JoinParams()) -> Joined:
    """Every link between different texts, and which documents are equal as sets."""
    attach(docs.sparkSession)
    p = params
    summary = _open_sets(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), p)
    # x names a text: the id, or where an id repeats a hash of id and set
    texts = summary.where("open and doc_id is not null").withColumn("x", F.col("doc_id"))
    again = texts.groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id", F.lit(True).alias("again"))
    repeats = not again.isEmpty()
    if repeats:
        texts = texts.join(again, "doc_id", "left").withColumn("x", F.when(F.col("again"), F.xxhash64("doc_id", "d1", "d2")).otherwise(F.col("doc_id")))
        texts = texts.dropDuplicates(["x"])
    members = texts.select("x", "doc_id", "d1", "d2")
    group = written(members.groupBy("d1", "d2").agg(F.min("x").alias("rep")), "classes")
    classes = members.join(group, ["d1", "d2"]).select("x", "doc_id", "rep")
    reps = written(texts.join(group.select(F.col("rep").alias("x")), "x", "left_semi").select("x", "n", "grams"), "reps")

    holds = written(_prefixes(reps, p), "holds")
    pieces = written(reps.select("x", "grams").mapInArrow(lambda it: _cut(it, p), "x long, fragment int, grams binary"), "pieces")
    unshared = F.struct(F.expr("h.nx - h.before - h.rest"), "h.x")

    def starred(met: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
        """Of rows (l, r) each r's best l, and of these pairs those that are near, with their overlap."""
        best = _possible(met, p).groupBy("b").agg(F.max(F.struct("hits", "a", "na", "nb")).alias("m"))
        best = written(best.select("m.a", "b", "m.na", "m.nb"), f"stars-{label}")
        return best, written(_counted(best, pieces).where(_alike(min(p.near, p.percent))), f"near-{label}")

    def placed_in(found: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(gram, h, c): c is the group of h's text; and of n-grams in several groups the most frequent one, its
        star there and how many rows are in others."""
        rows = holds.join(found.select(F.col("id").alias("h_x"), "component"), F.col("h.x") == F.col("h_x"), "left")
        rows = written(rows.select("gram", "h", F.coalesce("component", "h.x").alias("c")), "placed")
        shares = rows.groupBy("gram", "c").agg(F.count("*").alias("n"), F.min_by("h", unshared).alias("l"))
        return rows, shares.groupBy("gram").agg(F.max(F.struct("n", "c", "l")).alias("m"), F.count("*").alias("k")).where("k > 1").select("gram", F.col("m.c").alias("main"), F.col("m.l").alias("l"))

    # stars: the holder of each n-gram with the fewest n-grams of its own; then that of the most frequent group
    leaders = holds.groupBy("gram").agg(F.min_by("h", unshared).alias("l"), F.count("*").alias("held")).where("held > 1").select("gram", "l")
    best, counted = starred(holds.select("gram", F.col("h").alias("r")).join(leaders, "gram").where("l.x <> r.x"), "first")
    placed, shares = placed_in(components(counted.select("a", "b")))
    more, near = starred(placed.join(shares, "gram").where("c <> main").select("l", F.col("h").alias("r")), "second")
    best, counted = best.unionAll(more), counted.unionAll(near)
    discard(placed)

    # across groups: every other pair that shares an n-gram of its prefixes. The most frequent group of an n-gram
    # is compared with the others' rows only, never with itself
    found = components(counted.select("a", "b"))
    placed, shares = placed_in(found)
    open_ = placed.join(shares.select("gram", "main"), "gram")
    side = open_.where("c <> main").select("gram", F.col("h").alias("l"), F.col("c").alias("cl"))
    rest = open_.select("gram", F.col("h").alias("r"), F.col("c").alias("cr"), "main")
    met = side.join(rest, "gram").where(F.expr("cl <> cr and (cr = main or l.x < r.x)") & _meeting("l", "r", p)[0])
    tried = best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    others = _possible(met.select(F.least("l", "r").alias("l"), F.greatest("l", "r").alias("r")), p).select("a", "b", "na", "nb")
    others = written(others.join(tried, ["a", "b"], "left_anti"), "others")
    apart = counted.limit(0).select("a", "b")
    if not others.isEmpty():
        apart = written(_counted(others, pieces).where(_alike(p.percent)).select("a", "b"), "apart")

    # within groups: of two texts the overlap is counted already, of more every pair is counted in cells
    grouped = found.unionAll(found.select(F.col("component").alias("id"), "component").distinct()).select(F.col("id").alias("x"), F.col("component").alias("c")).join(reps, "x")
    sizes = grouped.groupBy("c").agg(F.count("*").alias("m"), F.sum("n").alias("total"))
    sizes = written(sizes.where("m > 2").select("c", F.greatest(F.ceil(F.col("m") / p.block_texts), F.ceil(F.col("total") / p.block_grams)).cast("int").alias("blocks")), "blocks")
    upper = found.select(F.col("id").alias("upper"), F.col("component").alias("c"))  # of two linked texts the larger is never a root
    pair = counted.where(_alike(p.percent)).join(upper, F.greatest("a", "b") == F.col("upper")).join(sizes.select("c"), "c", "left_anti").select("a", "b")
    dealt = grouped.join(sizes, "c").withColumn("own", F.pmod(F.xxhash64("x"), "blocks").cast("int"))
    dealt = dealt.select("c", "own", "x", "n", "grams", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"))
    cells = dealt.select("c", F.least("own", "j").alias("low"), F.greatest("own", "j").alias("high"), "own", "x", "n", "grams")
    for done in (holds, placed, others, pieces):
        discard(done)
    return Joined(p, summary.select("doc_id", "n"), classes, repeats, apart.unionAll(pair), cells)


def near_duplicates(docs: DataFrame, params: JoinParams = JoinParams()) -> DataFrame:
    """doc_id, n_shingles, component_id and n_links, one row for each row of docs.

    n_links counts the other texts (different as sets) that link with the document's.
    """
    joined = similarity_join(docs, params)
    summary, classes, repeats = joined.summary, joined.classes, joined.repeats
    counted = written(joined.counted(), "links")
    every = counted.where("x <> low").select(F.col("low").alias("a"), F.col("x").alias("b")).unionAll(classes.where("x <> rep").select(F.col("rep").alias("a"), F.col("x").alias("b")))
    if repeats:
        one = classes.groupBy("doc_id").agg(F.min("x").alias("a"))
        every = every.unionAll(classes.join(one, "doc_id").where("x <> a").select("a", F.col("x").alias("b")))
    placed = classes.join(components(every).withColumnRenamed("id", "x"), "x", "left").select("doc_id", "rep", F.coalesce("component", "x").alias("c"))
    low = placed.groupBy("c").agg(F.min("doc_id").alias("component_id"))
    links = counted.groupBy(F.col("x").alias("rep")).agg(F.sum("k").alias("k"))
    named = placed.join(low, "c").join(links, "rep", "left").select("doc_id", "component_id", F.coalesce("k", F.lit(0)).alias("k"))
    named = named.groupBy("doc_id").agg(F.min("component_id").alias("component_id"), F.sum("k").alias("k")) if repeats else named
    rows = summary.select("doc_id", F.col("n").alias("n_shingles")).join(named, "doc_id", "left")
    return rows.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("k", F.lit(0)).alias("n_links"))
