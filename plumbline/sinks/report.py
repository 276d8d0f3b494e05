"""Texts and JSON of reports: findings, checks, hooks, annotations, rankings, deltas.

A line is a column expression over a finding's row; what is capped is capped by a top-k for each kind, never by
ranking all rows in one window.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.scalar import round_to
from plumbline.operators.gate import number
from plumbline.operators.rank import placed

BOOLEANS = ("has_tests", "uses_cgo", "uses_reflect")
#: Fixed value: annotations of one kind that are shown for a step.
SHOWN = 10


def value_text(metric: Column, value: Column) -> Column:
    """true and false for flags, numbers to two decimals at most."""
    return F.when(metric.isin(*BOOLEANS), F.when(value != 0, "true").otherwise("false")).otherwise(number(round_to(value, 2)))


def finding_text(metric: Column, base: Column, head: Column, has_base: Column, limit: Column, suggestion: Column | None = None) -> Column:
    """`metric: base -> head, limit.` and the suggestion where there is one."""
    alone = F.when(metric == "changed_func_cognitive_max", " (changed since baseline)").otherwise(" (no baseline)")
    values = F.when(has_base, F.concat(value_text(metric, base), F.lit(" -> "), value_text(metric, head))).otherwise(F.concat(value_text(metric, head), alone))
    more = F.lit("") if suggestion is None else F.when(F.coalesce(suggestion, F.lit("")) != "", F.concat(F.lit(" "), suggestion)).otherwise("")
    return F.concat(metric, F.lit(": "), values, F.lit(", "), limit, F.lit("."), more)


def lines_of(findings: DataFrame) -> DataFrame:
    """package, section (violations, warnings, exempted), ord, line. findings: package, ord, metric, kind, base, head,
    has_base, label, reason (null: not exempted)."""
    text = finding_text(F.col("metric"), F.col("base"), F.col("head"), F.col("has_base"), F.col("label"))
    section = F.when(F.col("reason").isNotNull(), "exempted").when(F.col("kind") == "violation", "violations").otherwise("warnings")
    return findings.select("package", section.alias("section"), "ord", F.when(F.col("reason").isNotNull(), F.concat(text, F.lit(" Exempted: "), F.col("reason"))).otherwise(text).alias("line"))


def plural(n: Column, one: str) -> Column:
    return F.concat(n.cast("string"), F.when(n == 1, f" {one}").otherwise(f" {one}s"))


def summary_line(package: Column, violations: Column, warnings: Column, exempted: Column, new: Column) -> Column:
    return F.concat(package, F.lit(": "), plural(violations, "violation"), F.lit(", "), plural(warnings, "warning"), F.lit(", "), exempted.cast("string"), F.lit(" exempted"), F.when(new, ", new since baseline").otherwise(""))


def check_text(lines: DataFrame, summaries: DataFrame) -> str:
    """The text of a check, for one reader: sections in order, each package's lines under it, then the summaries
    (package, line). What comes to the driver is the report itself."""
    out: list[str] = []
    got = lines.orderBy("section", "package", "ord", "line").collect()
    for section in ("violations", "warnings", "exempted"):
        mine = [r for r in got if r["section"] == section]
        if mine:
            out.append(f"{section}:")
        for i, r in enumerate(mine):
            if i == 0 or mine[i - 1]["package"] != r["package"]:
                out.append(f"  {r['package']}")
            out.append(f"    {r['line']}")
    out += [r["line"] for r in summaries.orderBy("package").collect()]
    return "\n".join(out) + "\n" if out else "no changed packages\n"


def hook(lines: DataFrame) -> str:
    """What stops an agent: the block decision with every line as its reason when there is a violation, else {}."""
    if lines.where("section = 'violations'").isEmpty():
        return "{}\n"
    return json.dumps({"decision": "block", "reason": check_text(lines, lines.sparkSession.createDataFrame([], "package string, line string"))}, ensure_ascii=False) + "\n"


def escaped(text: Column, in_property: bool = False) -> Column:
    """Percent, line ends, and in properties also colons and commas, as workflow commands want them."""
    pairs = [("%", "%25"), ("\r", "%0D"), ("\n", "%0A"), *([(":", "%3A"), (",", "%2C")] if in_property else [])]
    for a, b in pairs:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def annotations(findings: DataFrame, rank: DataFrame | None = None) -> DataFrame:
    """place, command: ten errors, ten warnings and every notice, the packages that `rank` (package, place) names
    first, then by package. findings as `lines_of` takes them, with file and line (null: the package's directory)."""
    far = F.lit(1 << 30)
    rows = findings.withColumn("at", far) if rank is None else findings.join(rank.select("package", F.col("place").alias("r")), "package", "left").withColumn("at", F.coalesce("r", far)).drop("r")
    text = finding_text(F.col("metric"), F.col("base"), F.col("head"), F.col("has_base"), F.col("label"))
    kind = F.when(F.col("reason").isNotNull(), "notice").when(F.col("kind") == "violation", "error").otherwise("warning")
    full = F.when(F.col("reason").isNotNull(), F.concat(text, F.lit(" Exempted: "), F.col("reason"))).otherwise(text)
    spot = F.when(F.col("file").isNotNull(), F.concat(F.lit(" file="), escaped(F.col("file"), True), F.when(F.col("line") > 0, F.concat(F.lit(",line="), F.col("line").cast("string"))).otherwise(""))).otherwise(F.concat(F.lit(" file="), escaped(F.col("package"), True)))
    rows = rows.select("at", "package", "ord", "metric", kind.alias("what"), F.concat(F.lit("::"), kind, spot, F.lit("::"), escaped(full)).alias("command"))
    order = ["at", "package", "ord", "metric"]
    first = lambda what: rows.where(F.col("what") == what).orderBy(*order).limit(SHOWN)  # noqa: E731  a top-k report
    return first("error").unionByName(first("warning")).unionByName(rows.where("what = 'notice'")).select(*order, "what", "command")


def omitted(findings: DataFrame) -> DataFrame:
    """what, shown, hidden: how many errors and warnings are annotated, and how many aren't."""
    kind = F.when(F.col("kind") == "violation", "error").otherwise("warning")
    n = F.count("*")
    return findings.where("reason is null").groupBy(kind.alias("what")).agg(F.least(n, F.lit(SHOWN)).alias("shown"), F.greatest(n - SHOWN, F.lit(0)).alias("hidden"))


def package_json(rows: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """package, report: each package's report as JSON in a fixed order of keys; unknown metrics are null."""
    return rows.select("package", F.to_json(F.struct("package", *keys, F.struct(*metrics).alias("metrics")), {"ignoreNullFields": "false"}).alias("report"))


def deltas_json(pairs: DataFrame, counts: list[str], numbers: list[str]) -> DataFrame:
    """package, deltas: head less base for each metric, whole numbers for counts, null where head has none."""
    whole = [(F.col(f"h_{m}") - F.coalesce(f"b_{m}", F.lit(0))).cast("bigint").alias(m) for m in counts]
    real = [(F.col(f"h_{m}") - F.coalesce(f"b_{m}", F.lit(0))).cast("double").alias(m) for m in numbers]
    return pairs.select("package", F.to_json(F.struct(*whole, *real), {"ignoreNullFields": "false"}).alias("deltas"))


def grouped(value: Column) -> Column:
    """A number with its whole part in groups of three, without trailing zeros."""
    whole = F.format_number(F.floor(F.abs(value)), 0)
    text = F.rtrim(F.abs(value).cast("decimal(38, 6)").cast("string"), F.lit("0"))
    tail = F.regexp_extract(text, r"\.(\d+)$", 1)
    return F.concat(F.when(value < 0, "-").otherwise(""), whole, F.when(tail != "", F.concat(F.lit("."), tail)).otherwise(""))


def headroom_text(metric: Column, value: Column, limit: Column, remaining: Column) -> Column:
    room = F.when(remaining < 0, F.concat(grouped(-remaining), F.lit(" over"))).otherwise(F.concat(grouped(remaining), F.lit(" left")))
    return F.when(metric.isNull(), "-").otherwise(F.concat(metric, F.lit(" "), grouped(value), F.lit("/"), grouped(limit), F.lit(" ("), room, F.lit(")")))


#: A ranking's columns, those that are right-aligned, and the gap between them.
COLUMNS = ("PATH", "PASSES", "TIER", "DAYS", "FAN_IN", "TOKENS", "DUP%", "CHURN", "ROLE")
RIGHT = ("PASSES", "DAYS", "FAN_IN", "TOKENS", "DUP%", "CHURN")


def ranking_cells(rows: DataFrame) -> DataFrame:
    """place and a text for each of COLUMNS, from ranked rows with place."""
    one = lambda c: F.format_string("%.1f", F.col(c).cast("double"))
    low, high = one("days_low"), one("days_high")
    cells = {
        "PATH": F.col("package"), "PASSES": one("passes"), "TIER": F.col("tier"), "DAYS": F.when(low == high, low).otherwise(F.concat(low, F.lit("-"), high)),
        "FAN_IN": F.col("fan_in").cast("string"), "TOKENS": F.col("tokens_est").cast("string"), "DUP%": one("duplication_pct"),
        "CHURN": F.coalesce(F.col("churn_commits").cast("string"), F.lit("-")), "ROLE": F.coalesce(F.nullif("role", F.lit("")), F.lit("-")),
    }
    return rows.select("place", *[cells[c].alias(c) for c in COLUMNS])


def ranking_table(rows: DataFrame, order: list) -> DataFrame:
    """place, line: the ranking as a table, its header at place 0. Widths are one aggregate over all rows."""
    cells = ranking_cells(placed(rows, order, "place"))
    head = cells.sparkSession.createDataFrame([(0, *COLUMNS)], cells.schema)
    every = head.unionAll(cells)
    widths = every.agg(*[F.max(F.length(F.col(f"`{c}`"))).alias(f"w{i}") for i, c in enumerate(COLUMNS)])
    met = every.crossJoin(F.broadcast(widths))  # one row
    text = []
    for i, c in enumerate(COLUMNS):
        cell = F.lpad(F.col(f"`{c}`"), F.col(f"w{i}"), F.lit(" ")) if c in RIGHT else F.col(f"`{c}`")
        text.append(F.rpad(cell, F.col(f"w{i}") + 2, F.lit(" ")) if i < len(COLUMNS) - 1 else cell)
    return met.select(F.col("place").cast("bigint").alias("place"), F.concat(*text).alias("line"))


def run_summary(commits: DataFrame) -> DataFrame:
    """One row about a run: its commits, how many loaded, passed and failed, and its wall time."""
    return commits.agg(F.count("*").alias("commits"), F.count_if("loaded").alias("loaded"), F.count_if(F.col("loaded") & F.col("passed")).alias("passed"), F.count_if(F.col("loaded") & ~F.col("passed")).alias("failed"), F.sum("wall_ms").alias("wall_ms"))


def markdown_table(rows: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """place, line: rows as a Markdown table; text left, numbers right, unknown values empty, pipes escaped."""
    right = {c for c, t in rows.dtypes if t in ("int", "bigint", "double", "float") or t.startswith("decimal")}
    cell = lambda c: F.replace(F.coalesce(number(F.col(c)) if c in right else F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|"))
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in columns]), F.lit(" |"))
    body = placed(rows, [F.col(c) for c in order], "place").select((F.col("place") + 2).alias("place"), line.alias("line"))
    head = [(1, "| " + " | ".join(columns) + " |"), (2, "| " + " | ".join("---:" if c in right else "---" for c in columns) + " |")]
    return rows.sparkSession.createDataFrame(head, "place bigint, line string").unionAll(body)


def two_figures(value: Column) -> Column:
    """Rounded to two significant figures; below ten by a whole power of ten, so that 0.3 stays 0.3."""
    k = F.floor(F.log10(F.abs(value))) - 1
    up, down = F.pow(F.lit(10.0), -k), F.pow(F.lit(10.0), k)
    return F.when(value == 0, 0.0).when(k < 0, F.round(value * up) / up).otherwise(F.round(value / down) * down)


def emitted(fitted: Column, least: Column, kept: Column, fixed: Column) -> Column:
    """A fitted parameter as configuration takes it: kept where it was held, never under the least, two figures."""
    return F.when(fixed, kept).when(fitted < least, least).otherwise(two_figures(fitted))
