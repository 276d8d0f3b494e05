"""Configuration: conditions, rule shapes, versions, overrides and exemptions; parsed, checked, merged.

Rules come as rows too (`rule_errors`), so that a table of candidate rules is checked in one pass.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field, fields, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.scalar import glob_regex
from plumbline.plans.rules import SHIPPED, Rule, merge_rules

#: How calibrated versions begin, and the day of the rebuild fit.
REBUILD, THRESHOLDS, FIT_DATE = "rebuild-", "thresholds-", "2026-09-28"
ROLES = ("library", "main", "test-support", "generated-only")
#: Directory names, and words of directory names, that corpora leave out.
EXCLUDED_SEGMENTS = "__fixtures__ __mocks__ __tests__ bench benchmark benchmarks demo demos docs e2e example examples fixture fixtures playground sandbox test tests website www".split()
EXCLUDED_WORDS = "e2e spec specs test tests".split()


class ConfigError(ValueError):
    """Everything that is wrong with a configuration, one line each."""


def parse_condition(text: str) -> tuple[str, float]:
    """`metric > number`, blanks around either allowed."""
    left, mark, right = text.partition(">")
    name = left.strip()
    if not mark or not name or any(c in " \t\r\n<>=" for c in name):
        raise ConfigError(f"condition {text!r}: want `<metric> > <number>`")
    try:
        value = float(right.strip())
    except ValueError:
        value = math.nan
    if not math.isfinite(value):
        raise ConfigError(f"condition {text!r}: want a finite number after >")
    return name, value


_CONDITION = r"^\s*([^ \t\r\n<>=]+)\s*>\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)\s*$"


def condition(text: Column) -> Column:
    """The same for a column: struct metric, value; null where it isn't one."""
    return F.when(text.rlike(_CONDITION), F.struct(F.regexp_extract(text, _CONDITION, 1).alias("metric"), F.regexp_extract(text, _CONDITION, 2).try_cast("double").alias("value")))


def is_calibrated(version: Column) -> Column:
    """A rebuild calibration, or a gate calibration dated after the rebuild fit."""
    day = F.substring(version, len(THRESHOLDS) + 1, 10)
    real = day.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_timestamp(day, F.lit("yyyy-MM-dd")).isNotNull()
    return version.startswith(REBUILD) | (version.startswith(THRESHOLDS) & F.coalesce(real, F.lit(False)) & (day > FIT_DATE))


def excluded_package(path: Column) -> Column:
    """Lies under a directory that corpora leave out, by its name or a word of its name."""
    segments = F.split(path, "/")
    return F.arrays_overlap(segments, F.array(*map(F.lit, EXCLUDED_SEGMENTS))) | F.exists(segments, lambda s: F.arrays_overlap(F.split(s, "[-_.]+"), F.array(*map(F.lit, EXCLUDED_WORDS))))


#: What is wrong with a rule's shape: (condition over its columns, message). Null columns are unset.
SHAPE = (
    ("metric = ''", "metric is required"),
    ("metric <> '' and not known", "unknown metric"),
    ("kind = ''", "kind is required"),
    ("kind not in ('', 'density', 'capacity', 'requirement')", "unknown kind"),
    ("kind = 'density' and max is null and max_delta is null", "density rule needs max_delta or max"),
    ("kind = 'density' and max is not null and max_delta is null and ratchet", "ratchet_from_zero needs max_delta"),
    ("kind = 'capacity' and max is null", "capacity rule needs max"),
    ("kind = 'capacity' and max <= 0", "max must be > 0"),
    ("kind = 'capacity' and max_delta is not null", "capacity rule must not set max_delta"),
    ("kind = 'capacity' and (warn_at <= 0 or warn_at >= 1)", "warn_at must be in (0, 1)"),
    ("kind in ('density', 'requirement') and warn_at <> 0", "warn_at applies only to capacity rules"),
    ("kind in ('capacity', 'requirement') and ratchet", "ratchet_from_zero applies only to density rules"),
    ("kind = 'requirement' and require is null", "requirement rule needs require"),
    ("kind in ('density', 'capacity') and require is not null", "require applies only to requirement rules"),
    ("kind = 'requirement' and (max is not null or max_delta is not null)", "requirement rule must not set max or max_delta"),
    ("over_max_delta is not null and (kind = 'requirement' or kind = 'density' and metric <> 'changed_func_cognitive_max')", "over_max_delta applies only to capacity rules and changed_func_cognitive_max"),
    ("over_max_delta is not null and kind = 'density' and metric = 'changed_func_cognitive_max' and max is null", "over_max_delta needs max"),
    ("over_max_delta < 0 and (kind = 'capacity' or kind = 'density' and metric = 'changed_func_cognitive_max' and max is not null)", "over_max_delta must be a finite number >= 0"),
    ("floor is not null and kind in ('capacity', 'requirement')", "floor applies only to density rules"),
    ("severity not in ('', 'fail', 'warn')", "unknown severity"),
    ("bad_roles", "unknown role"),
    ("twice", "role listed twice"),
)


def rule_errors(rules: DataFrame, known: list[str]) -> DataFrame:
    """Adds errors, the list of what is wrong with each rule's shape. rules: metric, kind, severity, max, max_delta,
    floor, over_max_delta, warn_at, ratchet, require, roles."""
    rows = rules.withColumns({
        "known": F.col("metric").isin(*known),
        "bad_roles": F.exists("roles", lambda r: ~r.isin(*ROLES)),
        "twice": F.size(F.array_distinct("roles")) < F.size("roles"),
    })
    found = F.array_compact(F.array(*[F.when(F.coalesce(F.expr(test), F.lit(False)), F.lit(text)) for test, text in SHAPE]))
    return rows.withColumn("errors", found).drop("known", "bad_roles", "twice")


def checked(rule: Rule, known: tuple[str, ...] = ()) -> list[str]:
    """The same for one rule."""
    bad = rule.validate()
    if known and rule.metric not in known:
        bad.append(f"{rule.metric}: unknown metric")
    bad += [f"{rule.metric}: unknown role {r!r}" for r in rule.roles if r not in ROLES]
    if len(set(rule.roles)) < len(rule.roles):
        bad.append(f"{rule.metric}: role listed twice")
    return bad


@dataclass(frozen=True)
class Exemption:
    package: str
    metric: str
    reason: str
    expires: str | None = None


@dataclass(frozen=True)
class Config:
    version: str
    rules: tuple[Rule, ...] = SHIPPED
    languages: dict[str, tuple[Rule, ...]] = field(default_factory=dict)
    exclude: tuple[str, ...] = ()
    exemptions: tuple[Exemption, ...] = ()
    min_tokens: int = 100
    min_tokens_cross: int = 100

    def for_language(self, name: str) -> tuple[Rule, ...]:
        return merge_rules(self.rules, self.languages.get(name, ()))

    def with_exemptions(self, more: tuple[Exemption, ...]) -> Config:
        """Those of the file beside the configuration come after its own."""
        return replace(self, exemptions=self.exemptions + more)


def _rule(entry: dict, where: str, errors: list[str]) -> Rule:
    given = dict(entry)
    if isinstance(given.get("when"), str):
        try:
            given["when_metric"], given["when_value"] = parse_condition(given.pop("when"))
        except ConfigError as bad:
            errors.append(f"{where}: {bad}")
            given.pop("when", None)
    given["roles"] = tuple(given.get("roles") or ())
    names = {f.name for f in fields(Rule)}
    errors += [f"{where}: unknown key {k!r}" for k in given if k not in names]
    return Rule(**({"metric": "", "kind": ""} | {k: v for k, v in given.items() if k in names}))


def parse(data: dict) -> Config:
    """A configuration from nested dicts. Unknown keys and every rule, pattern or exemption that is wrong are reported
    together."""
    errors: list[str] = []
    known = {"version", "rules", "languages", "exclude", "exemptions", "min_tokens", "min_tokens_cross"}
    errors += [f"unknown key {k!r}" for k in data if k not in known]
    if not data.get("version"):
        errors.append("version is required")
    rules = tuple(_rule(r, f"rules[{i}]", errors) for i, r in enumerate(data.get("rules", [])))
    languages = {name: tuple(_rule(r, f"languages.{name}[{i}]", errors) for i, r in enumerate(rs)) for name, rs in data.get("languages", {}).items()}
    errors += [e for r in rules for e in checked(r)]
    for name, rs in languages.items():
        errors += [f"languages.{name}: {e}" for r in rs if not r.disabled for e in checked(r)]
        both = {r.metric for r in rs if r.disabled} & {r.metric for r in rs if not r.disabled}
        errors += [f"languages.{name}: {m} is disabled and overridden" for m in sorted(both)]
    for i, pattern in enumerate(data.get("exclude", [])):
        try:
            glob_regex(pattern)
        except ValueError as bad:
            errors.append(f"exclude[{i}] {pattern!r}: {bad}")
    exemptions = []
    for i, e in enumerate(data.get("exemptions", [])):
        x = Exemption(e.get("package", ""), e.get("metric", ""), e.get("reason", ""), e.get("expires"))
        errors += [f"exemptions[{i}]: {name} is required" for name in ("package", "metric", "reason") if not str(getattr(x, name)).strip()]
        exemptions.append(x)
    if errors:
        raise ConfigError("\n".join(errors))
    return Config(data["version"], rules or SHIPPED, languages, tuple(data.get("exclude", [])), tuple(exemptions), data.get("min_tokens", 100), data.get("min_tokens_cross", 100))


def load(text: str) -> Config:
    """From JSON, or YAML where a YAML reader is installed."""
    try:
        return parse(json.loads(text))
    except json.JSONDecodeError:
        try:
            import yaml
        except ImportError as gone:
            raise ConfigError("not JSON, and no YAML reader is installed") from gone
        return parse(yaml.safe_load(text))


def dump(config: Config) -> str:
    """JSON that `load` reads back."""
    plain = lambda r: {k: v for f in fields(Rule) if (v := getattr(r, k := f.name)) != f.default or k in ("metric", "kind")}
    return json.dumps({
        "version": config.version, "rules": [plain(r) for r in config.rules], "languages": {k: [plain(r) for r in v] for k, v in config.languages.items()},
        "exclude": list(config.exclude), "exemptions": [vars(e) for e in config.exemptions], "min_tokens": config.min_tokens, "min_tokens_cross": config.min_tokens_cross,
    }, indent=2)


def suggested(config: Config, noisy: list[str]) -> Config:
    """The configuration with the rules on the listed metrics made to warn."""
    soften = lambda rs: tuple(replace(r, severity="warn") if r.metric in noisy else r for r in rs)
    return replace(config, rules=soften(config.rules), languages={k: soften(v) for k, v in config.languages.items()})


def candidate(config: Config, version: str, fitted: dict[str, dict[str, float]]) -> Config:
    """The configuration with fitted limits (metric -> max, max_delta, floor) in place, under a new version."""
    return replace(config, version=version, rules=tuple(replace(r, **fitted.get(r.metric, {})) for r in config.rules))


def language_override(config: Config, name: str, fitted: dict[str, dict[str, float]]) -> Config:
    """The fitted limits as overrides of one language, beside those it has on other metrics."""
    rest = tuple(r for r in config.languages.get(name, ()) if r.metric not in fitted)
    own = tuple(replace(r, **fitted[r.metric]) for r in config.for_language(name) if r.metric in fitted)
    return replace(config, languages=config.languages | {name: rest + own})
