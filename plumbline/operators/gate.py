"""The gate: rules over (head, base) rows of package metrics, merged, exempted and summed up.

All of it is joins and CASE expressions: the rules and exemptions are small lists that are broadcast, the
package rows are shuffled once to meet their baseline. Null means "not computed" and never counts as 0 here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.scalar import EPSILON, round_to
from plumbline.plans.rules import MODULE_WIDE, Rule


def number(v: Column) -> Column:
    """A number as text without trailing zeros."""
    return F.when(v == F.floor(v), v.cast("bigint").cast("string")).otherwise(v.cast("double").cast("string"))


def to_long(wide: DataFrame, metrics: list[str], keys: list[str]) -> DataFrame:
    """keys, metric, value (double; booleans as 0 and 1). Null values keep their row."""
    cells = [F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics]
    return wide.select(*keys, F.explode(F.array(*cells)).alias("c")).select(*keys, "c.metric", "c.value")


def pair_rows(head: DataFrame, base: DataFrame, metrics: list[str]) -> DataFrame:
    """Head rows with their baseline: package, role, has_row, and for each metric h_ and b_ columns."""
    b = base.select("package", *[F.col(m).alias(f"b_{m}") for m in metrics], F.lit(True).alias("has_row"))
    h = head.select("package", F.coalesce(F.nullif("role", F.lit("")), F.lit("library")).alias("role"), *[F.col(m).alias(f"h_{m}") for m in metrics])
    return h.join(b, "package", "left").withColumn("has_row", F.coalesce("has_row", F.lit(False)))


def evaluate(pairs: DataFrame, rules: DataFrame, metrics: list[str]) -> DataFrame:
    """One row for each finding: package, ord, part, metric, severity, warning, base, head, has_base, label."""
    rise = F.lit(True)
    if {"duplicated_lines", "duplication_pct"} <= set(metrics):
        rise = F.when(F.col("metric") == "duplication_pct", F.coalesce(F.col("h_duplicated_lines") > F.col("b_duplicated_lines"), F.lit(True))).otherwise(rise)
    if {"changed_func_cognitive_max", "cognitive_p90"} <= set(metrics):
        rise = F.when(F.col("metric") == "cognitive_p90", F.coalesce(F.col("h_changed_func_cognitive_max") > F.col("b_cognitive_p90"), F.lit(True))).otherwise(rise)
    cells = [F.struct(F.lit(m).alias("metric"), F.col(f"h_{m}").cast("double").alias("head"), F.col(f"b_{m}").cast("double").alias("base")) for m in metrics]
    facts = ["h_sloc", "b_sloc", *[c for c in ("h_duplicated_lines", "b_duplicated_lines", "h_changed_func_cognitive_max", "b_cognitive_p90") if c in pairs.columns]]
    long = pairs.select("package", "role", "has_row", *facts, F.explode(F.array(*cells)).alias("c")).select("package", "role", "has_row", *facts, "c.*")
    met = long.join(F.broadcast(rules.where(~F.col("metric").isin(*MODULE_WIDE))), "metric")
    met = met.where(F.col("head").isNotNull() & ((F.size("roles") == 0) | F.array_contains("roles", F.col("role"))))
    met = met.withColumn("rose", ~F.col("has_row") | rise).withColumn("has_base", F.col("has_row") & F.col("base").isNotNull())
    h, eps = F.col("head"), EPSILON
    b = F.when(F.col("has_base"), F.col("base")).otherwise(0.0)
    limit, has = F.col("max"), F.col("has_base")
    allowed = F.coalesce("over_max_delta", F.lit(0.0))

    live = (F.col("kind") == "density") & F.col("rose") & F.coalesce(h > F.col("floor") + eps, F.lit(True))
    by_delta = live & F.col("max_delta").isNotNull() & (F.col("has_row") | F.col("ratchet")) & (~F.col("has_row") | F.col("base").isNotNull()) & (h - b > F.col("max_delta") + eps)
    crossed = F.when(h <= limit + eps, False).when(~has, True).when(h <= b + eps, False).when(F.col("max_delta").isNotNull() & (b >= limit - eps), False).otherwise(True)
    by_max = live & limit.isNotNull() & crossed

    large = (F.col("kind") == "capacity") & (limit > 0)
    over = large & (h > limit + eps)
    fresh = ~has | (b < limit - eps)
    warned = large & F.when(h > limit + eps, ~fresh & ((h <= b + eps) | ((allowed > 0) & (h - b <= allowed + eps)))).otherwise(h >= F.col("warn_at") * limit - eps)
    broken = over & ~warned
    beyond = over & ~fresh & (h > b + eps) & (allowed > 0)
    at_most = F.concat(F.lit("max "), number(limit))
    capacity_label = F.when(beyond, F.concat(F.lit("over max by "), number(h - limit), F.lit(", allowed "), number(allowed))).otherwise(at_most)

    guard = F.lit(True)
    for m in metrics:
        if m == "sloc":
            guard = F.when(F.col("when_metric") == m, F.coalesce(F.col(f"h_{m}") > F.col("when_value"), F.lit(False))).otherwise(guard)
    grew = ~F.col("has_row") | (F.col("h_sloc") > F.col("b_sloc"))
    lacking = (F.col("kind") == "requirement") & F.col("require").isNotNull() & guard & ((h != 0) != F.col("require")) & F.coalesce(grew, F.lit(False))

    def finding(part: int, when: Column, warning: Column, label: Column) -> Column:
        return F.when(when, F.struct(F.lit(part).alias("part"), warning.alias("warning"), label.alias("label")))

    found = F.array(
        finding(0, by_delta, F.lit(False), F.concat(F.lit("max_delta +"), number(F.col("max_delta")))),
        finding(1, by_max, F.lit(False), at_most),
        finding(2, broken, F.lit(False), capacity_label),
        finding(3, warned, F.lit(True), capacity_label),
        finding(4, lacking, F.lit(False), F.concat(F.lit("require "), F.col("require").cast("string"))),
    )
    out = met.withColumn("f", F.explode(F.filter(found, lambda x: x.isNotNull())))
    return out.select("package", "ord", "f.part", "metric", "severity", "f.warning", b.alias("base"), "head", "has_base", "f.label")


def notes(pairs: DataFrame, rules: DataFrame, metrics: list[str]) -> DataFrame:
    """package, metric of density rules whose max_delta was skipped: computed at head, not at baseline."""
    cells = [F.struct(F.lit(m).alias("metric"), F.col(f"h_{m}").cast("double").alias("head"), F.col(f"b_{m}").cast("double").alias("base")) for m in metrics]
    long = pairs.where("has_row").select("package", "role", F.explode(F.array(*cells)).alias("c")).select("package", "role", "c.*")
    met = long.join(F.broadcast(rules.where("kind = 'density' and max_delta is not null")), "metric")
    met = met.where(F.col("head").isNotNull() & F.col("base").isNull() & ((F.size("roles") == 0) | F.array_contains("roles", F.col("role"))) & F.coalesce(F.col("head") > F.col("floor") + EPSILON, F.lit(True)))
    return met.select("package", "metric")


#: A finding on the second metric is told with one on the first, in this order.
MERGES = (
    ("sloc", "tokens_est"),
    ("dup_blocks", "dup_blocks_code"),
    ("dup_blocks", "duplication_pct"),
    ("dup_blocks", "duplicated_lines"),
    ("dup_blocks_code", "duplication_pct"),
    ("dup_blocks_code", "duplicated_lines"),
    ("duplicated_lines", "duplication_pct"),
)


def direction(base: Column, head: Column, has_base: Column) -> Column:
    return F.when(~has_base, 1).otherwise(F.signum(head - base).cast("int"))


def merge_findings(findings: DataFrame) -> DataFrame:
    """Findings of one rule become one; then same-cause findings of equal severity and direction.

    Adds `also`, the metrics absorbed, in order. Warnings stay by themselves.
    """
    one = findings.groupBy("package", "ord", "metric", "severity", "warning", "base", "head", "has_base").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "label"))), lambda x: x["label"]), " and ").alias("label"))
    side = direction(F.col("base"), F.col("head"), F.col("has_base"))
    one = one.withColumn("side", side)
    near = Window.partitionBy("package", "severity", "warning", "side")
    here = F.collect_set("metric").over(near)
    keeper = F.lit(None).cast("string")
    for keep, drop in reversed(MERGES):
        keeper = F.when((F.col("metric") == drop) & F.array_contains("here", keep) & ~F.col("warning"), F.lit(keep)).otherwise(keeper)
    place = F.coalesce(*[F.when(F.col("metric") == d, F.lit(i)) for i, (_, d) in enumerate(MERGES)], F.lit(99))
    one = one.withColumn("here", here).withColumn("keeper", keeper).withColumn("place", place).drop("here")
    told = F.concat(F.col("metric"), F.lit(" "), F.when(F.col("has_base"), F.concat(number(round_to("base", 2)), F.lit(" -> "), number(round_to("head", 2)))).otherwise(number(round_to("head", 2))), F.lit(", "), F.col("label"))
    # the group's findings beside each: a package's few
    near_all = F.collect_list(F.when(F.col("keeper").isNotNull(), F.struct("place", F.col("metric").alias("m"), told.alias("told"), "keeper"))).over(near)
    out = one.withColumn("group", near_all).where("keeper is null")
    mine = F.array_sort(F.filter("group", lambda g: (g["keeper"] == F.col("metric")) & ~F.col("warning")))
    out = out.withColumn("gone", mine)
    label = F.concat_ws("; ", F.col("label"), F.transform("gone", lambda g: g["told"]))
    also = F.coalesce(F.transform("gone", lambda g: g["m"]), F.array().cast("array<string>"))
    kind = F.when(~F.col("warning") & (F.col("severity") == "fail"), "violation").otherwise("warning")
    return out.select("package", "ord", "metric", kind.alias("kind"), "severity", "warning", "base", "head", "has_base", label.alias("label"), also.alias("also"))


def exempt(findings: DataFrame, exemptions: DataFrame, today: str) -> DataFrame:
    """Adds `reason`: the first unexpired exemption's, where exemptions cover the metric and every `also`.

    exemptions: ord, package, metric, reason, expires (date; the last day counts); configuration, so a package's are
    one broadcast row and a finding is decided in its own. Plain warnings aren't exempted."""
    valid = exemptions.where((F.trim("reason") != "") & (F.col("expires").isNull() | (F.col("expires") >= F.lit(today).cast("date"))))
    per = valid.groupBy("package").agg(F.array_sort(F.collect_list(F.struct("ord", "metric", "reason"))).alias("__ex"))
    met = findings.join(F.broadcast(per), "package", "left")
    asked = F.array_distinct(F.concat(F.array("metric"), "also"))
    hits = F.filter("__ex", lambda x: F.array_contains(asked, x["metric"]))
    covered = F.size(F.array_distinct(F.transform(hits, lambda x: x["metric"]))) == F.size(asked)
    return met.withColumn("reason", F.when(~F.col("warning") & F.coalesce(covered, F.lit(False)), F.get(hits, 0)["reason"])).drop("__ex")


def verdicts(findings: DataFrame, packages: DataFrame) -> DataFrame:
    """package, violations, warnings, exempted, passed for every package."""
    counts = findings.groupBy("package").agg(
        F.count_if((F.col("kind") == "violation") & F.col("reason").isNull()).alias("violations"),
        F.count_if((F.col("kind") == "warning") & F.col("reason").isNull()).alias("warnings"),
        F.count_if(F.col("reason").isNotNull()).alias("exempted"),
    )
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("violations", "warnings", "exempted")]
    return packages.select("package").distinct().join(counts, "package", "left").select("package", *zero).withColumn("passed", F.col("violations") == 0)


def stale_exemptions(exemptions: DataFrame, findings: DataFrame, today: str) -> DataFrame:
    """ord, package, metric, notice of exemptions past their day and of those that cover no finding."""
    late = F.col("expires").isNotNull() & (F.col("expires") < F.lit(today).cast("date"))
    used = findings.where("not warning").select("package", F.explode(F.concat(F.array("metric"), "also")).alias("metric")).distinct().withColumn("used", F.lit(True))
    out = exemptions.join(used, ["package", "metric"], "left")
    return out.withColumn("notice", F.when(late, "expired").when(F.col("used").isNull(), "stale")).where("notice is not null").select("ord", "package", "metric", "notice")


def ceilings(rows: DataFrame, rules: DataFrame, metrics: list[str]) -> DataFrame:
    """package, ord, metric, value, max, remaining, used of every capacity rule that judges a row."""
    long = to_long(rows, metrics, ["package", "role"]).where("value is not null")
    role = F.coalesce(F.nullif("role", F.lit("")), F.lit("library"))
    met = long.join(F.broadcast(rules.where("kind = 'capacity' and max > 0")), "metric").where((F.size("roles") == 0) | F.array_contains("roles", role))
    return met.select("package", "ord", "metric", "value", "max", round_to(F.col("max") - F.col("value"), 3).alias("remaining"), round_to(F.col("value") / F.col("max"), 3).alias("used"))


def headroom(limits: DataFrame) -> DataFrame:
    """The tightest ceiling of each package, the first rule on ties."""
    best = limits.groupBy("package").agg(F.max(F.struct("used", -F.col("ord"), "metric", "remaining")).alias("m"))
    return best.select("package", F.col("m.metric").alias("metric"), F.col("m.remaining").alias("remaining"), F.col("m.used").alias("used"))


def with_headroom(rows: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Adds headroom_metric, headroom_left and headroom_used: the tightest ceiling that judges the row, the first rule
    on ties; null where none does. It is worked out within the row, without a join."""
    role = F.coalesce(F.nullif("role", F.lit("")), F.lit("library"))
    cells = []
    for i, r in enumerate(rules):
        if r.kind != "capacity" or not r.max or r.metric not in rows.columns:
            continue
        v = F.col(r.metric).cast("double")
        judges = v.isNotNull() & (role.isin(*r.roles) if r.roles else F.lit(True))
        cells.append(F.when(judges, F.struct(round_to(v / r.max, 3).alias("used"), F.lit(-i).alias("i"), F.lit(r.metric).alias("metric"), round_to(r.max - v, 3).alias("left"))))
    best = F.array_max(F.array_compact(F.array(*cells)))
    return rows.withColumn("__h", best).select(*rows.columns, F.col("__h.metric").alias("headroom_metric"), F.col("__h.left").alias("headroom_left"), F.col("__h.used").alias("headroom_used"))


def covered_values(head: Column, base: Column, head_covered: Column, base_covered: Column, has_row: Column) -> tuple[Column, Column]:
    """What a rule that reads coverage judges: the covered figures if head has one and so has the baseline, if any."""
    use = head_covered.isNotNull() & (~has_row | base_covered.isNotNull())
    return F.when(use, head_covered).otherwise(head), F.when(use, base_covered).otherwise(base)


def worst_changed(changed: DataFrame, limit: float, allowed: float) -> DataFrame:
    """Of functions (package, ord, name, cognitive, base_cognitive) those over the limit that fail: the most
    complex of each package, the first on ties."""
    h, b = F.col("cognitive"), F.col("base_cognitive")
    fails = (h > limit + EPSILON) & (b.isNull() | (b < limit - EPSILON) | (h - b > allowed + EPSILON))
    first = F.row_number().over(Window.partitionBy("package").orderBy(h.desc(), "ord"))
    return changed.where(fails).withColumn("rn", first).where("rn = 1").drop("rn")
