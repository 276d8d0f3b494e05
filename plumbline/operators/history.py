"""Replayed history: episodes, carried values, rates, sweeps, advice, look-ahead labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.scalar import share
from plumbline.operators.labels import is_fix, reverted_hashes, reverted_subject


def episodes(log: DataFrame, key: list[str]) -> DataFrame:
    """Consecutive blocks of a key up to its first pass: one row each, with the pass where there is one.

    log: key, ord, event (block or pass), value. A pass with nothing open is ignored. Order is the log's own.
    """
    before = Window.partitionBy(*key).orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    n = F.coalesce(F.count_if(F.col("event") == "pass").over(before), F.lit(0))
    rows = log.withColumn("episode", n)
    is_block = F.col("event") == "block"
    out = rows.groupBy(*key, "episode").agg(
        F.count_if(is_block).alias("blocks"),
        F.min(F.when(is_block, F.col("ord"))).alias("blocked_at"),
        F.max_by("value", F.when(is_block, F.col("ord"))).alias("head"),
        F.min(F.when(F.col("event") == "pass", F.col("ord"))).alias("resolved_at"),
        F.max_by("value", F.when(F.col("event") == "pass", F.col("ord"))).alias("passed"),
    )
    return out.where("blocks > 0")


def resolution(head: Column, passed: Column, resolved: Column, fall: float = 0.25) -> Column:
    """How an episode ended; the first rule wins."""
    return F.when(resolved.isNull(), "open").when((head > 0) & ((head - passed) / head >= fall), "split").when(passed < head, "reduced").otherwise("unexplained")


def carried_before(rows: DataFrame, key: list[str]) -> DataFrame:
    """Adds `before`: the row's own base, else the nearest earlier head (0 after a deletion), else the nearest
    later base, else 0. rows: key, seq, base, head, deleted."""
    w = Window.partitionBy(*key).orderBy("seq")
    state = F.when(F.col("deleted"), 0).otherwise(F.col("head"))
    earlier = F.last(state, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    later = F.first("base", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    return rows.withColumn("before", F.coalesce("base", earlier, later, F.lit(0)))


def rates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """block, allow, block_failed, allow_failed, recall, false_failure, precision (null without failures), j.

    rows: keys, block (label), failed (verdict)."""
    b, f = F.col("block"), F.col("failed")
    out = rows.groupBy(*keys).agg(F.count_if(b).alias("blocks"), F.count_if(~b).alias("allows"), F.count_if(b & f).alias("block_failed"), F.count_if(~b & f).alias("allow_failed"))
    out = out.withColumn("recall", share("block_failed", "blocks")).withColumn("false_failure", share("allow_failed", "allows"))
    n = F.col("block_failed") + F.col("allow_failed")
    return out.withColumn("precision", F.when(n > 0, share(F.col("block_failed"), n))).withColumn("j", F.col("recall") - F.col("false_failure"))


def sweep(rows: DataFrame, settings: DataFrame) -> DataFrame:
    """Every row under every setting, in one pass: rule, value, and the rates of failing where fact > value.

    rows: rule, fact, block. settings (rule, value, shipped) is a small grid and is broadcast; each row meets
    only its own rule's settings, and the counts combine before they are shuffled."""
    met = rows.join(F.broadcast(settings), "rule")
    return rates(met.withColumn("failed", F.col("fact") > F.col("value")), ["rule", "value", "shipped"])


def best_within(points: DataFrame, budget: float) -> DataFrame:
    """Of each rule's points within the budget of false failures the one that fails most blocks, then fewest
    allows, then the shipped one, then the smallest value."""
    w = Window.partitionBy("rule").orderBy(F.col("block_failed").desc(), "allow_failed", F.col("shipped").desc(), "value")
    return points.where(F.col("false_failure") <= budget + 1e-12).withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def least_false(points: DataFrame) -> DataFrame:
    w = Window.partitionBy("rule").orderBy("allow_failed", "value")
    return points.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def advice(points: DataFrame, budget: float) -> DataFrame:
    """rule, advice (keep, retune or drop) and the value it names."""
    best = best_within(points, budget).select("rule", F.col("value").alias("best"), F.col("block_failed").alias("b"))
    shipped = points.where("shipped").select("rule", F.col("value").alias("now"), "false_failure", F.col("block_failed").alias("s"))
    met = shipped.join(best, "rule", "left")
    kept = (F.col("false_failure") <= budget + 1e-12) & (F.col("s") >= F.col("b"))
    pick = F.when(F.col("best").isNull() | (F.col("b") == 0), "drop").when(kept, "keep").otherwise("retune")
    return met.select("rule", pick.alias("advice"), F.when(pick == "retune", F.col("best")).otherwise(F.col("now")).alias("value"))


def verdict_by_commit(rows: DataFrame) -> DataFrame:
    """commit, rule, failed: any of its rows fails."""
    return rows.groupBy("commit", "rule").agg(F.bool_or("failed").alias("failed"))


def pending(commits: DataFrame, done: DataFrame) -> DataFrame:
    """Commits not yet recorded, in order; a recorded run of another configuration version is refused."""
    other = done.join(commits.select("version").distinct(), "version", "left_anti")
    if not other.isEmpty():
        raise ValueError("the recorded run has another configuration version")
    return commits.join(done.select("commit"), "commit", "left_anti").orderBy("seq")


def views(rows: DataFrame, key: str) -> DataFrame:
    """Counts for each value of key and for all together (null), by grouping sets."""
    return rows.rollup(key).agg(F.count("*").alias("n"), F.count_if("block").alias("blocks"))


def subject_facts(rows: DataFrame, subject: str) -> DataFrame:
    """Adds is_fix, reverted_subject (null without one) and reverted_hashes."""
    s = F.col(subject)
    return rows.withColumn("is_fix", is_fix(s)).withColumn("reverted_subject", reverted_subject(s)).withColumn("reverted_hashes", reverted_hashes(s))


def capacity_only(rows: DataFrame) -> Column:
    """A blocked label that names rules, all of them capacity rules, without evidence or a fix-up reason."""
    m = F.col("metrics")
    return F.col("block") & (F.size(m) > 0) & (F.size("fired") == 0) & ~F.col("reason").startswith("fixed up by") & ~F.col("reason").startswith("reverted by") & F.forall(m, lambda x: x.isin("tokens_est", "largest_file_sloc", "exported_symbols", "internal_imports", "sloc"))
