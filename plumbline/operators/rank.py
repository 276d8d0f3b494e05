"""Estimates and rankings of packages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import scalar as S
from plumbline.sources.shared import ensure_shared


def estimates(rows: DataFrame, p: S.RebuildParams = S.RebuildParams()) -> DataFrame:
    """Adds the five terms, rebuild_tokens, agent_passes, tier, human days of both models and their range."""
    p.validate()
    terms = S.estimate_terms(p)
    out = rows.select("*", *[c.alias(f"t_{n}") for n, c in terms.items()])
    out = out.withColumn("rebuild_tokens", sum((F.col(f"t_{n}") for n in S.TERMS[1:]), F.col(f"t_{S.TERMS[0]}")))
    passes = S.agent_passes(F.col("rebuild_tokens"), p)
    basic, second = S.human_days(p)
    out = out.withColumn("agent_passes", passes).withColumn("days_81", basic).withColumn("days_ii", second)
    return out.withColumn("tier", S.tier(F.col("agent_passes"), p)).withColumn("days_low", F.least("days_81", "days_ii")).withColumn("days_high", F.greatest("days_81", "days_ii"))


def drivers(rows: DataFrame, top: int = 2) -> DataFrame:
    """Adds drivers: the names of the largest terms above zero, ties in term order."""
    cells = F.array(*[F.struct((-F.col(f"t_{n}")).alias("t"), F.lit(i).alias("i"), F.lit(n).alias("n")) for i, n in enumerate(S.TERMS)])
    ordered = F.slice(F.array_sort(F.filter(cells, lambda x: x["t"] < 0)), 1, top)
    return rows.withColumn("drivers", F.transform(ordered, lambda x: x["n"]))


def rank_rows(rows: DataFrame) -> DataFrame:
    """The rounded row of every package, as it is ranked and shown. rows: estimates with headroom_used."""
    out = rows
    return out.select(
        "package",
        S.round_to("agent_passes", 1).alias("passes"),
        S.round_to("days_ii", 1).alias("days"),
        S.round_to("days_low", 1).alias("days_low"),
        S.round_to("days_high", 1).alias("days_high"),
        "tier", "fan_in", "tokens_est", "duplication_pct", "churn_commits", "headroom_used",
    ).withColumn("hotspot", S.hotspot(F.col("churn_commits"), F.col("passes")))


#: sort key -> the value it sorts by, descending
SORT_KEYS = {
    "passes": F.col,
    "days": F.col,
    "fan_in": F.col,
    "tokens": lambda _: F.col("tokens_est"),
    "duplication": lambda _: F.col("duplication_pct"),
    "churn": lambda _: F.coalesce("churn_commits", F.lit(-1)),
    "hotspot": F.col,
    "headroom": lambda _: F.coalesce("headroom_used", F.lit(-1.0)),
}


def sort_order(key: str) -> list:
    """Ordering of a sort key: descending, hotspots then by low days, the package last."""
    if key not in SORT_KEYS:
        raise ValueError(f"unknown sort key {key!r}: want one of {', '.join(SORT_KEYS)}")
    more = [F.col("days_low").desc()] if key == "hotspot" else []
    return [SORT_KEYS[key](key).desc(), *more, F.col("package")]


def top(rows: DataFrame, key: str, n: int | None = None) -> DataFrame:
    """Rows in the order of a key; with n the first n, each task keeping n only."""
    out = rows.orderBy(*sort_order(key))
    return out.limit(n) if n is not None else out


def hotter(rows: DataFrame) -> DataFrame:
    """The report's order: hotspot, passes, low days, all descending, then package."""
    return rows.orderBy(F.col("hotspot").desc(), F.col("passes").desc(), F.col("days_low").desc(), "package")


def bands(rows: DataFrame, limits: DataFrame) -> DataFrame:
    """Adds over (ceilings exceeded) and band."""
    over = limits.where("value > max").groupBy("package").agg(F.count("*").alias("over"))
    out = rows.join(over, "package", "left").withColumn("over", F.coalesce("over", F.lit(0)))
    return out.withColumn("band", S.risk_band(F.col("tier"), F.col("over"), F.col("duplication_pct")))


def module_totals(rows: DataFrame) -> DataFrame:
    """Sum of the rounded days, to whole days, and packages by band. Tenths are added up as whole numbers, so the
    sum doesn't depend on the order of the rows."""
    tenths = F.sum(F.round(F.col("days") * 10).cast("bigint"))
    return rows.agg(F.round(tenths / 10).alias("days"), F.count("*").alias("packages"), F.count_if(F.col("band") == "split").alias("split"), F.count_if(F.col("band") == "watch").alias("watch"))


def placed(rows: DataFrame, order: list, name: str) -> DataFrame:
    """Adds each row's place, from 1, in one order over all rows. A distributed sort: the place is the number of rows
    in the partitions before and the place in the row's own, so no task sees all rows. The sorted rows are written to
    the checkpoint folder, and only each partition's number of rows comes to the driver."""
    spark = rows.sparkSession
    ensure_shared(spark)
    ids = rows.orderBy(*order).withColumn("__id", F.monotonically_increasing_id()).checkpoint()
    part, before, starts = F.shiftright("__id", 33), 0, []
    for p, n in sorted((r[0], r[1]) for r in ids.groupBy(part).count().collect()):
        starts += [F.lit(p), F.lit(before)]
        before += n
    if not starts:
        return rows.withColumn(name, F.lit(None).cast("bigint"))
    start = F.create_map(*starts)[part].cast("bigint")
    return ids.withColumn(name, start + F.col("__id") - F.shiftleft(part, 33) + 1).drop("__id")


def with_ranks(rows: DataFrame, keys: tuple[str, ...] = tuple(SORT_KEYS)) -> DataFrame:
    """Places under several keys."""
    for key in keys:
        rows = placed(rows, sort_order(key), f"by_{key}")
    return rows
