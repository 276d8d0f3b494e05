"""The shipped rule set, language overrides, and the rules table that plans broadcast (its size is the list's)."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Rule:
    metric: str
    kind: str
    severity: str = "fail"
    max_delta: float | None = None
    max: float | None = None
    floor: float | None = None
    over_max_delta: float | None = None
    warn_at: float = 0.75
    ratchet: bool = False
    require: bool | None = None
    when_metric: str | None = None
    when_value: float | None = None
    roles: tuple[str, ...] = ()
    disabled: bool = False

    def validate(self) -> list[str]:
        """What is wrong with the rule's shape."""
        bad = []
        if self.kind not in ("density", "capacity", "requirement"):
            bad.append(f"{self.metric}: unknown kind {self.kind!r}")
        if self.severity not in ("fail", "warn"):
            bad.append(f"{self.metric}: unknown severity {self.severity!r}")
        if self.kind == "density" and self.max is None and self.max_delta is None:
            bad.append(f"{self.metric}: a density rule needs max or max_delta")
        if self.kind == "capacity" and (self.max is None or self.max_delta is not None):
            bad.append(f"{self.metric}: a capacity rule needs max and no max_delta")
        if self.kind == "requirement" and self.require is None:
            bad.append(f"{self.metric}: a requirement needs require")
        if not 0 <= self.warn_at <= 1:
            bad.append(f"{self.metric}: warn_at must be between 0 and 1")
        return bad


_L, _T, _G, _M = "library", "test-support", "generated-only", "main"

#: The shipped rules, in order.
SHIPPED = (
    Rule("dup_blocks", "density", max_delta=0, ratchet=True),
    Rule("duplication_pct", "density", max_delta=6, max=40, floor=10),
    Rule("untested_exports", "density", "warn", max_delta=0, ratchet=True, roles=(_L, _G)),
    Rule("globals", "density", "warn", max_delta=0, ratchet=True),
    Rule("init_funcs", "density", max_delta=0, ratchet=True),
    Rule("max_nesting", "density", max_delta=0, max=5, floor=4),
    Rule("cognitive_p90", "density", "warn", max_delta=3, max=20, floor=10),
    Rule("changed_func_cognitive_max", "density", max=50, over_max_delta=5),
    Rule("dup_blocks_cross_pkg", "density", max_delta=0, max=450),
    Rule("tokens_est", "capacity", max=16000, over_max_delta=2000),
    Rule("largest_file_sloc", "capacity", max=600, over_max_delta=50),
    Rule("exported_symbols", "capacity", max=60, over_max_delta=5, roles=(_L, _T, _G)),
    Rule("internal_imports", "capacity", "warn", max=10, over_max_delta=1, roles=(_L, _T, _G)),
    Rule("sloc", "capacity", max=1000, over_max_delta=150),
    Rule("has_tests", "requirement", require=True, when_metric="sloc", when_value=100, roles=(_L, _T, _G)),
    Rule("has_tests", "requirement", require=True, when_metric="sloc", when_value=300, roles=(_M,)),
)

#: What TypeScript replaces.
TYPESCRIPT = (
    replace(SHIPPED[1], max_delta=7, max=45),
    replace(SHIPPED[5], max=7),
    replace(SHIPPED[6], max_delta=4, max=25),
    replace(SHIPPED[7], max=55),
    replace(SHIPPED[9], max=35000, over_max_delta=4400),
    replace(SHIPPED[10], max=900, over_max_delta=75),
    replace(SHIPPED[11], max=55),
    replace(SHIPPED[12], max=8),
    replace(SHIPPED[13], max=2500, over_max_delta=375),
)

MODULE_WIDE = ("dup_blocks_cross_pkg",)


def merge_rules(rules: tuple[Rule, ...], overrides: tuple[Rule, ...]) -> tuple[Rule, ...]:
    """Disabled metrics go; a metric's overrides, all of them, stand where its first rule stood; new ones come last."""
    off = {r.metric for r in overrides if r.disabled}
    own = [r for r in overrides if not r.disabled]
    heads = {r.metric: i for i, r in reversed(list(enumerate(rules)))}
    out: list[Rule] = []
    for i, r in enumerate(rules):
        mine = [o for o in own if o.metric == r.metric]
        if r.metric not in off:
            out += mine if mine and heads[r.metric] == i else [] if mine else [r]
    return tuple(out + [r for r in own if r.metric not in heads])


def rule_views(top: tuple[Rule, ...], languages: dict[str, tuple[Rule, ...]]) -> tuple[list[tuple[str | None, Rule]], list[tuple[str | None, int, int]]]:
    """(rules, views): every distinct rule with the language that brought it, top-level ones first; and for each
    language (None: those without overrides) its (language, place, rule) in order."""
    found: list[tuple[str | None, Rule]] = [(None, r) for r in top]
    views: list[tuple[str | None, int, int]] = [(None, i, i) for i in range(len(top))]
    for name in sorted(languages):
        for place, r in enumerate(merge_rules(top, languages[name])):
            at = next((i for i, t in enumerate(top) if t == r), None)
            if at is None:
                at = len(found)
                found.append((name, r))
            views.append((name, place, at))
    return found, views


def views_table(spark: SparkSession, top: tuple[Rule, ...], languages: dict[str, tuple[Rule, ...]]) -> DataFrame:
    """rule, language, place, metric, roles, module_wide, warns: what `measure.judged_by` broadcasts."""
    found, views = rule_views(top, languages)
    rows = [(i, name, place, found[i][1].metric, list(found[i][1].roles), found[i][1].metric in MODULE_WIDE, found[i][1].severity == "warn") for name, place, i in views]
    return spark.createDataFrame(rows, "rule int, language string, place int, metric string, roles array<string>, module_wide boolean, warns boolean")


def rules_table(spark: SparkSession, rules: tuple[Rule, ...] = SHIPPED) -> DataFrame:
    bad = [x for r in rules for x in r.validate()]
    if bad:
        raise ValueError("; ".join(bad))
    rows = [(i, r.metric, r.kind, r.severity, _f(r.max_delta), _f(r.max), _f(r.floor), _f(r.over_max_delta), float(r.warn_at), r.ratchet, r.require, r.when_metric, _f(r.when_value), list(r.roles)) for i, r in enumerate(rules)]
    return spark.createDataFrame(rows, "ord int, metric string, kind string, severity string, max_delta double, max double, floor double, over_max_delta double, warn_at double, ratchet boolean, require boolean, when_metric string, when_value double, roles array<string>")


def rules_sql(rules: tuple[Rule, ...] = SHIPPED) -> str:
    """The same table as a DuckDB subquery."""
    lit = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v).upper() if isinstance(v, bool) else f"CAST({v} AS DOUBLE)"
    rows = ", ".join(f"({i}, '{r.metric}', '{r.kind}', '{r.severity}', {lit(r.max_delta)}, {lit(r.max)}, {lit(r.floor)}, {lit(r.over_max_delta)}, {lit(float(r.warn_at))}, {lit(r.ratchet)}, CAST({lit(r.require)} AS BOOLEAN), CAST({lit(r.when_metric)} AS VARCHAR), CAST({lit(r.when_value)} AS DOUBLE), CAST([{', '.join(repr(x) for x in r.roles)}] AS VARCHAR[]))" for i, r in enumerate(rules))
    return f"(SELECT * FROM (VALUES {rows}) t(ord, metric, kind, severity, max_delta, max, floor, over_max_delta, warn_at, ratchet, require, when_metric, when_value, roles))"


def _f(v: float | None) -> float | None:
    return None if v is None else float(v)
