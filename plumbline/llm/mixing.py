"""Mixing sources to target weights by cube-method balanced sampling.

Every source gets a target number of words. A document is taken floor(target / source size) times whole and
once more with a fractional inclusion probability. The cube method then moves the probabilities along null
vectors of the constraints (documents and words taken stay the same) until they are 0 or 1. The flight runs
in blocks of bounded size within a source; the two or fewer undecided documents of each block fly on
together, with a few decided ones, level by level. Each source lands in the level where one block of it is
left, whatever the other sources' sizes: its last two are rounded, and the block's decisions are turned over
where that brings its words nearer to the target.

Nulls: a null text has size 0; null sources are one source, last in order. Repeated rows are separate
documents. Documents that tie in size are taken in the order of a hash of id and size, then id; rows alike in
these too are interchangeable. Texts of any length are counted whole. A source without words has target 0; an
empty table gives an empty result. Columns besides doc_id, text and source are ignored, whatever their names.
Draws are seeded by source, level and block: reruns agree.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, written


@dataclass(frozen=True)
class MixParams:
    #: Weights of the sources in code point order, repeating.
    weights: tuple[float, ...] = (1.0, 2.0, 3.0)
    #: A target is at most so many times its source's size.
    most_repeats: float = 3.0
    block_rows: int = 4000
    #: Tables with a row for each source are broadcast up to this many rows, and joined by a shuffle beyond.
    broadcast_rows: int = 100_000
    seed: int = 7


def source_targets(sizes: DataFrame, params: MixParams) -> DataFrame:
    """source, source_size, target, whole, part: one row for each source of the rows (source, size).

    Sources take their weight by their place in code point order, null last. Targets share out all sizes by weight;
    what is above most_repeats x size is shared again among the others, round by round. Only two sums a round,
    and how many sources each partition of the sorted list holds, come to the driver.
    """
    spark = sizes.sparkSession
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # a distributed sort; the high bits of the id are the partition, the low ones the place in it
    order = written(totals.orderBy(F.col("source").asc_nulls_last()).withColumn("id", F.monotonically_increasing_id()), "sources")
    held = sorted((r[0], r[1]) for r in order.groupBy(F.shiftright("id", 33)).count().collect())
    before, starts = 0, []
    for part, n in held:
        starts.append((part, before))
        before += n
    starts = spark.createDataFrame(starts, "part long, before long")
    weights = F.array(*[F.lit(float(w)) for w in params.weights])
    place = F.col("before") + F.col("id") - F.shiftleft(F.col("part"), 33)
    table = order.withColumn("part", F.shiftright("id", 33)).join(F.broadcast(starts), "part")
    table = table.select("source", "source_size", F.get(weights, (place % len(params.weights)).cast("int")).alias("weight"), (F.col("source_size") * params.most_repeats).alias("most"), F.lit(None).cast("double").alias("target"))
    rest = float(table.agg(F.sum("source_size")).first()[0] or 0)
    while True:
        open_ = table.where("target is null").agg(F.sum("weight")).first()[0]
        if not open_:
            break
        unit = rest / open_
        over = F.col("target").isNull() & (F.col("weight") * unit > F.col("most"))
        gone = table.where(over).agg(F.sum("most"), F.count("*")).first()
        if not gone[1]:
            table = table.withColumn("target", F.coalesce("target", F.col("weight") * unit))
            break
        rest -= gone[0]
        table = written(table.withColumn("target", F.when(over, F.col("most")).otherwise(F.col("target"))), "targets")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(ratio + 1e-12).cast("long")
    return written(table.select("source", "source_size", "target", whole.alias("whole"), F.greatest(F.lit(0.0), ratio - whole).alias("part")), "plan")


def fly(p: list[float], size: list[float], draw, land: bool) -> list[float]:
    """Flight phase on probabilities p with constraints sum(p) and sum(p * size); with `land` also the landing."""
    p, eps = list(p), 1e-9
    active: list[int] = []

    def move(units: list[int], u: list[float]) -> None:
        up = min((1 - p[i]) / d if d > 0 else p[i] / -d for i, d in zip(units, u) if d)
        down = min(p[i] / d if d > 0 else (1 - p[i]) / -d for i, d in zip(units, u) if d)
        step = up if draw() * (up + down) < down else -down
        for i, d in zip(units, u):
            p[i] += step * d
            p[i] = 0.0 if p[i] < eps else 1.0 if p[i] > 1 - eps else p[i]

    for i in range(len(p)):
        if not 0 < p[i] < 1:
            continue
        active.append(i)
        while len(active) == 3:
            a, b, c = active
            u = [size[b] - size[c], size[c] - size[a], size[a] - size[b]]
            largest = max(map(abs, u))
            move(active, [x / largest for x in u] if largest else [1.0, -1.0, 0.0])
            active = [j for j in active if 0 < p[j] < 1]
    while land and active:
        if len(active) == 2 and size[active[0]] and size[active[1]]:
            a, b = active
            largest = max(size[a], size[b])
            move(active, [size[b] / largest, -size[a] / largest])
        else:
            p[active[0]] = float(round(p[active[0]]))
        active = [j for j in active if 0 < p[j] < 1]
    return p


def fly_large_first(p: list[float], size: list[float], draw) -> list[float]:
    """Decide documents of equal probability from the largest down while the smaller ones can make up for it.

    Each move is along the null vector that changes one document and, affinely in size, all smaller ones, so
    that documents and words taken stay the same. The smaller ones' probabilities stay an affine function of
    size, so a move costs the same however many they are. Sizes come in descending order. It ends where a
    smaller document's probability would leave 0 to 1; what is left is for `fly`.
    """
    n = len(p)
    if n < 4 or max(p) - min(p) > 1e-12:
        return p
    out, a, b = list(p), p[0], 0.0
    count, total, square = float(n), float(sum(size)), float(sum(s * s for s in size))
    k = 0
    while k < n - 3:
        big = size[k]
        count, total, square = count - 1, total - big, square - big * big
        det = count * square - total * total
        if det <= 1e-9 * max(1.0, count * square):
            break
        own = a + b * big
        c, d = -(square - total * big) / det, -(count * big - total) / det
        ends = [(a + c * m + (b + d * m) * s) for m in (1 - own, -own) for s in (size[k + 1], size[-1])]
        if min(ends) < 0 or max(ends) > 1 or not 0 < own < 1:
            break
        move = 1 - own if draw() < own else -own
        out[k], a, b = (1.0 if move > 0 else 0.0), a + c * move, b + d * move
        k += 1
    for i in range(k, n):
        out[i] = min(1.0, max(0.0, a + b * size[i]))
    return out


def settle(p: list[float], wanted: float, size: list[float], tries: int = 8) -> list[float]:
    """Landing where all of a source is at hand: turn over the decision that brings the words nearest to
    `wanted`, while that helps. The first of equals is taken, so reruns agree."""
    p, s = np.array(p), np.array(size)
    off = float((p * s).sum()) - wanted
    for _ in range(tries):
        after = np.abs(off + np.where(p > 0.5, -s, s))
        i = int(after.argmin()) if len(s) else 0
        if not len(s) or after[i] >= abs(off):
            break
        off += -s[i] if p[i] > 0.5 else s[i]
        p[i] = 1 - p[i]
    return p.tolist()


def _flight(pdf: pd.DataFrame, level: int, params: MixParams) -> pd.DataFrame:
    land, seed = int(pdf["blocks"].iloc[0]) == 1, params.seed
    # the largest first: what stays undecided at the end is small, and so is the landing's error
    # rows alike in all of these are interchangeable
    pdf = pdf.sort_values(["size", "h", "doc_id", "p"], ascending=[False, True, True, True], kind="stable")
    name = repr((pdf["source"].iloc[0] if pd.notna(pdf["source"].iloc[0]) else None, level, int(pdf["block"].iloc[0]), seed))
    rng = np.random.Generator(np.random.PCG64(xxhash.xxh3_64_intdigest(name.encode("utf-8", "surrogatepass"))))
    draws = iter(rng.random(4 * len(pdf) + 8).tolist())
    size, draw = pdf["size"].astype(float).tolist(), lambda: next(draws)
    p = fly_large_first(pdf["p"].tolist(), size, draw)
    p = fly(p, size, draw, land)
    if land:
        p = settle(p, float((pdf["p"] * pdf["size"]).sum()), size)
    pdf = pdf.assign(p=p).drop(columns=["block", "blocks"])
    on = np.zeros(len(pdf), bool)
    if not land:
        # the undecided fly on, and some decided ones for the source's settling
        decided = pdf["p"].isin((0.0, 1.0)).to_numpy()
        order = np.lexsort((pdf["h"], ~decided))
        on = ~decided
        on[order[: min(int(decided.sum()), max(0, params.block_rows // 64 - 2))]] = True
    return pdf.assign(on=on)


def _flier(level: int, params: MixParams):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return _flight(pdf, level, params)

    return run


def mix(docs: DataFrame, params: MixParams = MixParams()) -> DataFrame:
    """doc_id, source, size, source_size, target, taken; one row for each row of docs."""
    spark = docs.sparkSession
    attach(spark)
    sizes = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("size"))
    sizes = written(sizes, "sizes")
    plan = source_targets(sizes, params)
    few = plan.limit(params.broadcast_rows + 1).count() <= params.broadcast_rows

    def by_source(rows: DataFrame, table: DataFrame) -> DataFrame:
        table = table.withColumnRenamed("source", "name")
        return rows.join(F.broadcast(table) if few else table, F.col("source").eqNullSafe(F.col("name")), "left").drop("name")

    rows = by_source(sizes, plan)
    settled = rows.where(~(F.col("part") > 0)).select("doc_id", "source", "size", F.lit(0.0).alias("p"))
    todo = rows.where("part > 0").select("doc_id", "source", "size", F.col("part").alias("p"), F.xxhash64("doc_id", "size").alias("h"))
    schema, done, level = "doc_id long, source string, size long, p double, h long, on boolean", [settled], 0
    while True:
        blocks = written(todo.groupBy("source").agg(F.ceil(F.count("*") / params.block_rows).alias("blocks")), f"blocks{level}")
        dealt = by_source(todo, blocks).select("doc_id", "source", "size", "p", "h", F.pmod(F.xxhash64("h", F.lit(level)), "blocks").alias("block"), "blocks")
        flown = dealt.groupBy("source", "block").applyInPandas(_flier(level, params), schema)
        flown = written(flown, f"flight{level}")
        done.append(flown.where("not on").select("doc_id", "source", "size", "p"))
        if blocks.where("blocks > 1").isEmpty():
            break
        todo, level = flown.where("on").drop("on"), level + 1
    every = done[0]
    for d in done[1:]:
        every = every.unionAll(d)
    taken = by_source(every, plan)
    return taken.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * (F.col("whole") + F.col("p").cast("long"))).alias("taken"))
