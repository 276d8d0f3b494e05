"""Aggregations from facts to package metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.scalar import round_to


def size(files: DataFrame, chars_per_token: float = 3.2) -> DataFrame:
    """package, files, sloc, largest file (the first on ties), its sloc, and tokens: bytes summed, divided once."""
    top = F.max(F.struct("sloc", -F.col("file"), "file"))
    out = files.groupBy("package").agg(F.count("*").alias("files"), F.sum("sloc").alias("sloc"), top.alias("m"), F.sum("bytes").alias("b"))
    return out.select("package", "files", "sloc", F.col("m.file").alias("largest_file"), F.col("m.sloc").alias("largest_file_sloc"), F.floor(F.col("b") / chars_per_token).alias("tokens_est"))


def complexity(functions: DataFrame) -> DataFrame:
    """package, func_count, total, max_nesting, p90 (nearest rank)."""
    return functions.groupBy("package").agg(F.count("*").alias("func_count"), F.sum("value").alias("total"), F.max("nesting").alias("max_nesting"), F.expr("CAST(percentile_disc(0.9) WITHIN GROUP (ORDER BY value) AS BIGINT)").alias("p90"))


def churn(touches: DataFrame, last: int) -> DataFrame:
    """package, commits, authors (ignoring case and outer space) of the last commits; touches: seq, package, author.

    The window is the feature: the cut is the last-th highest sequence number, found by a top-k of the numbers."""
    cut = touches.select("seq").distinct().orderBy(F.col("seq").desc()).limit(last).agg(F.min("seq").alias("cut"))
    inside = touches.join(F.broadcast(cut), F.col("seq") >= F.col("cut"))
    return inside.groupBy("package").agg(F.count_distinct("seq").alias("commits"), F.count_distinct(F.lower(F.trim("author"))).alias("authors"))


def coverage(blocks: DataFrame) -> DataFrame:
    """file, stmts, ran, pct; blocks: file, span, stmts, count. Counts of one span add up first."""
    merged = blocks.groupBy("file", "span").agg(F.max("stmts").alias("stmts"), F.sum("count").alias("count"))
    out = merged.groupBy("file").agg(F.sum("stmts").alias("stmts"), F.sum(F.when(F.col("count") > 0, F.col("stmts"))).alias("ran"))
    return out.withColumn("pct", round_to(F.try_divide(F.col("ran") * 100.0, F.col("stmts")), 1))


def buckets(rows: DataFrame, key: str, value: str, easy: int = 10, care: int = 20) -> DataFrame:
    v = F.col(value)
    return rows.groupBy(key).agg(F.count_if(v <= easy).alias("easy"), F.count_if((v > easy) & (v <= care)).alias("care"), F.count_if(v > care).alias("hard"))


def rule_summary(failures: DataFrame) -> DataFrame:
    """rule, failed, alone of distinct (c, rule): commits that failed it, and those that failed nothing else."""
    one = failures.distinct()
    per = one.groupBy("c").agg(F.count("*").alias("k"))
    return one.join(per, "c").groupBy("rule").agg(F.count("*").alias("failed"), F.count_if(F.col("k") == 1).alias("alone"))


def distribution(rows: DataFrame, key: str, value: str) -> DataFrame:
    """n, min, max, nearest-rank percentiles and interquartile range of each key's values."""
    kind = rows.schema[value].dataType  # a percentile is one of the values
    pct = {f"p{p}": F.expr(f"percentile_disc({p / 100}) WITHIN GROUP (ORDER BY {value})").cast(kind).alias(f"p{p}") for p in (25, 50, 75, 90, 95, 99)}
    out = rows.groupBy(key).agg(F.count(value).alias("n"), F.min(value).alias("min"), F.max(value).alias("max"), *pct.values())
    return out.withColumn("iqr", F.col("p75") - F.col("p25"))


def histogram(rows: DataFrame, key: str, value: str, bins: int = 10) -> DataFrame:
    """key, bin, count: bins - 1 equal ones from the least value to the 95th percentile, and an open one above.

    The stats are one row for each key and join back, so no group's values are gathered."""
    closed = bins - 1
    stats = rows.groupBy(key).agg(F.min(value).alias("lo"), F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY {value})").alias("hi"))
    met = rows.select(key, value).join(stats, key)
    width = (F.col("hi") - F.col("lo")).cast("double") / closed
    at = F.when(F.col(value) > F.col("hi"), closed).when(width == 0, 0).otherwise(F.least(F.floor(F.try_divide(F.col(value) - F.col("lo"), width)), F.lit(closed - 1)))
    return met.groupBy(key, at.cast("int").alias("bin")).agg(F.count("*").alias("count"))


def weighted_values(counts: DataFrame, key: str) -> DataFrame:
    """key, value, n of maps value -> count, pooled."""
    return counts.select(key, F.explode("counts").alias("value", "c")).groupBy(key, "value").agg(F.sum("c").alias("n"))


def weighted_percentile(pooled: DataFrame, key: str, p: float) -> DataFrame:
    """Nearest-rank percentile of (key, value, n) without expanding the counts."""
    w = Window.partitionBy(key).orderBy("value")
    total = F.sum("n").over(Window.partitionBy(key))
    placed = pooled.withColumn("upto", F.sum("n").over(w)).withColumn("all", total)
    return placed.where(F.col("upto") >= F.ceil(F.col("all") * p - 1e-9)).groupBy(key).agg(F.min("value").alias("value"))


def mean_ranks(rows: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """Adds fractional ranks: ties share the mean of their places."""
    w = Window.partitionBy(key).orderBy(value)
    ties = F.count("*").over(Window.partitionBy(key, value))
    return rows.withColumn(name, F.rank().over(w) + (ties - 1) / 2)


POOLS = ("all rows", "cloned-module rows only", "functions of all rows", "module rows")
STD, MODULE_ROW = "std", "<module>"


def pool_of(metric: str, module_wide: tuple[str, ...] = ("dup_blocks_cross_pkg",)) -> str:
    """Which rows a metric is fitted from."""
    if metric == "internal_imports":
        return POOLS[1]
    if metric == "changed_func_cognitive_max":
        return POOLS[2]
    return POOLS[3] if metric in module_wide else POOLS[0]


def in_pool(pool: str, module: Column, package: Column) -> Column:
    """A module row is of the module rows only; a package row of every other pool, but std's not of the cloned."""
    whole = package == MODULE_ROW
    if pool == POOLS[3]:
        return whole
    return ~whole & (module != STD) if pool == POOLS[1] else ~whole


def one_language(rows: DataFrame) -> DataFrame:
    """module of each row, distinct and in order; rows of two languages are refused."""
    found = [r[0] for r in rows.select("language").distinct().limit(2).collect()]
    if len(found) > 1:
        raise ValueError(f"rows of two languages: {found[0]} and {found[1]}")
    return rows.select("module").distinct().orderBy("module")


def grouped_reasons(rows: DataFrame, reason: str, item: str) -> DataFrame:
    """reason, n, first: items by reason, the largest group first, then the reason."""
    return rows.groupBy(reason).agg(F.count("*").alias("n"), F.min(item).alias("first")).orderBy(F.col("n").desc(), reason)


def first_chunks(spans: DataFrame, count: int = 2) -> DataFrame:
    """package, place, file, first_line, last_line, lines: two places of a package's longest block. spans: package,
    tokens, block, file, first_line, last_line. A block has two places or more, so the first two are one block's."""
    w = Window.partitionBy("package").orderBy(F.col("tokens").desc(), "block", "file", "first_line")
    rows = spans.withColumn("place", F.row_number().over(w)).where(F.col("place") <= count)
    return rows.select("package", "place", "file", "first_line", "last_line", (F.col("last_line") - F.col("first_line") + 1).alias("lines"))


def module_story(rows: DataFrame) -> DataFrame:
    """One row about a module: packages, days to a tenth, packages by band and the share of the code to split first."""
    n = F.count("*")
    band = lambda b: F.count_if(F.col("band") == b).alias(b)
    tokens = F.sum(F.col("tokens_est"))
    return rows.agg(n.alias("packages"), (F.sum(F.round(F.col("days") * 10).cast("bigint")) / 10).alias("days"), band("split"), band("watch"), band("fine"), (F.sum(F.when(F.col("band") == "split", F.col("tokens_est")).otherwise(0)) * 1000 / tokens).cast("bigint").alias("split_permille"))
