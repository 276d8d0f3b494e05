"""Connected components of a link table, by alternating star contractions in DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component) for every id in links (a, b): component is the smallest id reachable.

    Each round links every vertex to the smallest in its neighbourhood (large star, then small star), so
    the rounds grow with the logarithm of the longest chain. Each round's links are written to the shared
    folder; no vertex's neighbours are gathered in one place, only their minimum.
    """
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    for _ in range(rounds):
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        after = written(small.select("e.a", "e.b").where("a <> b").distinct(), "links")
        # a star forest: every vertex on the left once, and no root is itself on the left
        left = after.groupBy("a").agg(F.count("*").alias("n"))
        done = after.join(after.select(F.col("a").alias("b")).distinct(), "b", "left_semi").isEmpty() and left.where("n > 1").isEmpty()
        discard(edges)
        edges = after
        if done:
            break
    else:
        raise RuntimeError("the links form chains too long for the given number of rounds")
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
