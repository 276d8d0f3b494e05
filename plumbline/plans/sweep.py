"""What a sweep varies: each rule's limits, their shipped values, and the settings it tries."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession

from plumbline.plans.rules import Rule

#: What a sweep of each limit tries, as shares of the shipped value or as values.
MAX_SHARES = (0.5, 0.75, 1, 1.25, 1.5, 2, 3, 5)
DELTAS = (0, 1, 2, 3, 5, 10, 20)
OVER_DELTAS = (1, 2, 3, 5, 10, 20, 25, 50, 100, 150, 200, 300, 500, 1000, 1500, 2000, 3000, 5000)
GUARDS = (0, 50, 100, 200, 500, 1000)
FLOORS = (0, 1, 2, 3, 4, 5, 8, 10, 15, 20, 30)
CHANGED = "changed_func_cognitive_max"


@dataclass(frozen=True)
class Setting:
    """A value of a limit; None takes the limit away."""

    limit: str
    value: float | None

    def __str__(self) -> str:
        shown = "none" if self.value is None else f"{self.value:g}"
        if self.limit == "when":
            return "no guard" if self.value is None else f"when > {shown}"
        return f"{self.limit} {shown}"


def limits(rule: Rule) -> list[str]:
    """The limits of a rule that a sweep can vary, in order."""
    has = {
        "max": rule.max is not None,
        "max_delta": rule.max_delta is not None,
        "over_max_delta": rule.max is not None and (rule.kind == "capacity" or rule.metric == CHANGED),
        "when": rule.when_metric is not None,
        "floor": rule.floor is not None,
    }
    return [name for name, there in has.items() if there]


def shipped(rule: Rule, limit: str) -> Setting:
    value = rule.when_value if limit == "when" else getattr(rule, limit)
    return Setting(limit, 0.0 if value is None else float(value))


def applied(rule: Rule, setting: Setting) -> Rule:
    """The rule with a setting in place of its limit."""
    if setting.limit == "when":
        return replace(rule, when_value=setting.value, when_metric=rule.when_metric if setting.value is not None else None)
    return replace(rule, **{setting.limit: setting.value})


def _half_up(v: float) -> float:
    return float(int(v + 0.5))


def grid(rule: Rule, limit: str) -> list[Setting]:
    """The settings a sweep of the limit tries, ascending, the shipped one among them; taking the limit away comes
    last, where the rule keeps another."""
    now = shipped(rule, limit).value
    if limit == "max":
        values = {_half_up(now * s) for s in MAX_SHARES} | {now}
    elif limit == "max_delta":
        values = {float(v) for v in DELTAS} | {now, 2 * now}
    elif limit == "over_max_delta":
        values = {0.0, now} | {float(v) for v in OVER_DELTAS if rule.max / 1000 <= v <= rule.max / 2}
    elif limit == "when":
        values = {float(v) for v in GUARDS} | {now}
    else:
        values = {now} | {float(v) for v in FLOORS if rule.max is None or v < rule.max}
    removable = {"max": rule.kind == "density" and rule.max_delta is not None, "max_delta": rule.max is not None, "when": True, "floor": True}.get(limit, False)
    return [Setting(limit, v) for v in sorted(values)] + ([Setting(limit, None)] if removable else [])


def settings_table(spark: SparkSession, rules: tuple[Rule, ...]) -> DataFrame:
    """rule, metric, limit, value (null: taken away), shipped: every setting of every limit, for a sweep to broadcast."""
    rows = [(i, r.metric, limit, s.value, s == shipped(r, limit)) for i, r in enumerate(rules) for limit in limits(r) for s in grid(r, limit)]
    return spark.createDataFrame(rows, "rule int, metric string, limit string, value double, shipped boolean")
