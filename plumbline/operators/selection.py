"""Choosing packages for experiments: eligibility, strata, slots, trees."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.scalar import RebuildParams, agent_passes, round_to, tier


def eligible(rows: DataFrame, most_passes: float) -> DataFrame:
    """Rows that may be chosen: of a module with a repository, known to be without cgo and generated files, with a
    function, of few enough passes, and with tests or an importer.

    rows: module, package, repo (null: not cloned), uses_cgo, generated_files, func_count, agent_passes, has_tests,
    fan_in, fan_in_tests. An unknown flag or count keeps a row out."""
    return rows.where(
        F.col("repo").isNotNull()
        & F.coalesce(~F.col("uses_cgo"), F.lit(False))
        & F.coalesce(F.col("generated_files") == 0, F.lit(False))
        & (F.col("func_count") > 0)
        & (F.col("agent_passes") <= most_passes)
        & (F.col("has_tests") | (F.col("fan_in") + F.col("fan_in_tests") > 0))
    )


class StaleEstimate(ValueError):
    """Recorded passes don't follow from the metrics under today's parameters."""


def recomputed(rows: DataFrame, p: RebuildParams) -> DataFrame:
    """Adds passes and tier from rebuild_tokens; a row whose recorded agent_passes is another number is refused."""
    out = rows.withColumn("passes", agent_passes(F.col("rebuild_tokens"), p)).withColumn("tier", tier(F.col("passes"), p))
    wrong = out.where(round_to("passes", 1) != F.col("agent_passes")).select("package").first()
    if wrong is not None:
        raise StaleEstimate(f"{wrong[0]}: its recorded passes are of other parameters")
    return out


def strata(rows: DataFrame) -> DataFrame:
    """Adds stratum, its size, and the row's place in it (from 0) by rounded tokens, then package."""
    out = rows.withColumn("stratum", F.concat_ws("/", "tier", F.when(F.col("has_tests"), "tested").otherwise("untested")))
    w = Window.partitionBy("stratum").orderBy(F.round("rebuild_tokens"), "package")
    return out.withColumn("place", F.row_number().over(w) - 1).withColumn("size", F.count("*").over(Window.partitionBy("stratum")))


@dataclass(frozen=True)
class SelectionRule:
    #: Slots of each stratum, in the order strata are filled.
    slots: tuple[tuple[str, int], ...]
    most_per_module: int = 2


def select(placed: DataFrame, rule: SelectionRule, accept=lambda row: True) -> list[dict]:
    """The verdicts in the order they are reached: slot k of a stratum's n takes the first row from place k * size / n
    on that is untried, whose module has room, and that `accept` takes; a refused row ends its slot.

    A slot asks for one row (a top-1 of what is left), so the number of rows doesn't matter; slots are few by
    definition."""
    tried: list[str] = []
    per_module: dict[str, int] = {}
    verdicts: list[dict] = []
    sizes = {r["stratum"]: r["size"] for r in placed.groupBy("stratum").agg(F.max("size").alias("size")).collect()}
    for name, slots in rule.slots:
        for k in range(slots):
            start = k * sizes.get(name, 0) // slots
            full = [m for m, n in per_module.items() if n >= rule.most_per_module]
            left = placed.where((F.col("stratum") == name) & (F.col("place") >= start) & ~F.col("package").isin(tried) & ~F.col("module").isin(full))
            row = left.orderBy("place").limit(1).collect()
            if not row:
                continue
            tried.append(row[0]["package"])
            ok = bool(accept(row[0]))
            verdicts.append({"stratum": name, "slot": k, "module": row[0]["module"], "package": row[0]["package"], "ok": ok})
            if ok:
                per_module[row[0]["module"]] = per_module.get(row[0]["module"], 0) + 1
    return verdicts


def below(path: Column) -> Column:
    """Every directory that a path lies in or is: a, a/b, a/b/c."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def trees(rows: DataFrame, p: RebuildParams, least: int, most: int, most_passes: float) -> DataFrame:
    """module, root, packages, tokens, passes of the packages that, with all below them, make a tree of `least` to
    `most` packages, none with cgo or generated files, of few enough passes: the rounded tokens summed, put through
    the curve once.

    rows: module, package (a path in the module; '.' the root), is_main, uses_cgo, generated_files, rebuild_tokens.
    A package meets its ancestors by equality on their paths, as many as it is deep."""
    known = rows.where("not is_main")
    bad = F.coalesce(F.col("uses_cgo"), F.lit(True)) | F.coalesce(F.col("generated_files") > 0, F.lit(True))
    members = known.where("package <> '.'").select("module", F.explode(below(F.col("package"))).alias("root"), F.round("rebuild_tokens").cast("bigint").alias("tokens"), bad.alias("bad"))
    roots = known.where("package <> '.'").select("module", F.col("package").alias("root")).distinct()
    sums = members.join(roots, ["module", "root"], "left_semi").groupBy("module", "root").agg(F.count("*").alias("packages"), F.sum("tokens").alias("tokens"), F.bool_or("bad").alias("bad"))
    out = sums.withColumn("passes", agent_passes(F.col("tokens").cast("double"), p))
    return out.where(~F.col("bad") & F.col("packages").between(least, most) & (F.col("passes") <= most_passes)).drop("bad")
