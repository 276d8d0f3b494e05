"""Scalar functions over columns: rounding, ratios, the rebuild estimate and its ratings."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-9


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round_to(value: Column | str, places: int) -> Column:
    """Half away from zero on the scaled value: 1.005 to two places is 1.0, not 1.01."""
    scale = 10.0**places
    return F.round(col(value).cast("double") * scale) / scale


def share(part: Column | str, whole: Column | str) -> Column:
    """part / whole, 0 without a whole."""
    return F.when(col(whole) == 0, 0.0).otherwise(F.try_divide(col(part).cast("double"), col(whole).cast("double")))


def delta(head: Column | str, base: Column | str) -> Column:
    """Head minus base; null if head is, with a null base counted as 0."""
    return col(head) - F.coalesce(col(base), F.lit(0))


def instability(fan_out: Column, fan_in: Column) -> Column:
    return F.when(fan_out + fan_in > 0, fan_out.cast("double") / (fan_out + fan_in)).otherwise(0.0)


def abstractness(interfaces: Column, types: Column) -> Column:
    return F.when(types > 0, F.try_divide(interfaces.cast("double"), types.cast("double"))).otherwise(0.0)


def main_sequence_distance(abstract: Column, unstable: Column) -> Column:
    """From unrounded parts."""
    return F.abs(abstract + unstable - 1)


# COCOMO II's published constants, scale factors and multipliers that the profile picks.
COCOMO_A, COCOMO_B = 2.94, 0.91
#: very_low to extra_high of the scale factors
SCALE_FACTORS = {
    "prec": (6.20, 4.96, 3.72, 2.48, 1.24, 0),
    "flex": (5.07, 4.05, 3.04, 2.03, 1.01, 0),
    "resl": (7.07, 5.65, 4.24, 2.83, 1.41, 0),
    "team": (5.48, 4.38, 3.29, 2.19, 1.10, 0),
    "pmat": (7.80, 6.24, 4.68, 3.12, 1.56, 0),
}
DOCU = (0.81, 0.91, 1.0, 1.11, 1.23)
CPLX = (0.73, 0.87, 1.0, 1.17, 1.34, 1.74)
LEVELS = ("very_low", "low", "nominal", "high", "very_high", "extra_high")


@dataclass(frozen=True)
class RebuildParams:
    """The shipped parameters."""

    context_budget: float = 37500.0
    tokens_per_export: float = 0.0
    tokens_per_untested_export: float = 300.0
    tokens_per_hidden_state: float = 0.0
    exponent: float = 1.0
    cocomo_a: float = 2.4
    cocomo_b: float = 1.05
    days_per_month: float = 19.0
    one_pass_max: float = 1.0
    few_passes_max: float = 3.0
    unfamiliarity: float = 1.0
    ratings: dict[str, str] = field(default_factory=lambda: {"prec": "very_high", "flex": "very_low", "resl": "extra_high", "team": "nominal", "pmat": "nominal"})
    docu: str = "very_low"

    def validate(self) -> None:
        """Raises ValueError that names every bad parameter."""
        bad = [f"{n} must be positive" for n in ("context_budget", "days_per_month", "cocomo_a") if getattr(self, n) <= 0]
        bad += [f"{n} must not be negative" for n in ("tokens_per_export", "tokens_per_untested_export", "tokens_per_hidden_state") if getattr(self, n) < 0]
        bad += [f"unknown rating {v!r} of {k}" for k, v in {**self.ratings, "docu": self.docu}.items() if v not in LEVELS]
        if self.few_passes_max < self.one_pass_max:
            bad.append("few_passes_max must not be below one_pass_max")
        if not 0 <= self.unfamiliarity <= 1:
            bad.append("unfamiliarity must be between 0 and 1")
        if bad:
            raise ValueError("; ".join(bad))

    @property
    def coefficient(self) -> float:
        return COCOMO_A * DOCU[LEVELS.index(self.docu)]

    @property
    def scale_exponent(self) -> float:
        return COCOMO_B + 0.01 * sum(SCALE_FACTORS[k][LEVELS.index(v)] for k, v in self.ratings.items())


TERMS = ("volume", "spec", "contract", "unspecified", "hidden_state")


def estimate_terms(p: RebuildParams) -> dict[str, Column]:
    """The five terms of the rebuild estimate, in tokens, over metric columns."""
    covered = F.least(F.greatest(F.col("coverage_pct"), F.lit(0.0)), F.lit(100.0))
    untested = F.col("untested_exports") * F.lit(p.tokens_per_untested_export)
    return {
        "volume": F.col("tokens_est") * (1 - F.col("duplication_pct") / 100),
        "spec": F.greatest(F.col("tokens_est_with_tests") - F.col("tokens_est"), F.lit(0)).cast("double"),
        "contract": F.col("exported_symbols") * F.lit(p.tokens_per_export),
        "unspecified": F.when(F.col("coverage_pct").isNull(), untested).otherwise(untested * (1 - covered / 100)),
        "hidden_state": (F.col("globals") + F.col("init_funcs")) * F.lit(p.tokens_per_hidden_state),
    }


def agent_passes(tokens: Column, p: RebuildParams) -> Column:
    """Above one context budget the ratio grows by the exponent."""
    ratio = tokens / p.context_budget
    return F.when(ratio > 1, F.pow(ratio, F.lit(p.exponent))).otherwise(ratio)


def tier(passes: Column, p: RebuildParams) -> Column:
    return F.when(passes <= p.one_pass_max, "ONE_PASS").when(passes <= p.few_passes_max, "FEW_PASSES").otherwise("PARTITION")


def sub_score(value: Column, cuts: tuple[float, ...]) -> Column:
    """4 down to 0: at most the first cut, the second, and so on."""
    out = F.lit(None).cast("int")
    for i, c in enumerate(cuts):
        out = F.when(value <= c, 4 - i) if i == 0 else out.when(value <= c, 4 - i)
    return out.otherwise(0)


def understanding() -> Column:
    """COCOMO II's software understanding, 10 to 50, from three sub-scores rounded down together."""
    exports = F.greatest(F.col("exported_symbols"), F.lit(1))
    clamp = lambda c: F.least(F.greatest(c.cast("double") / exports, F.lit(0.0)), F.lit(1.0))
    missing = (0.05, 0.15, 0.35, 0.6)
    structure = F.least(sub_score(F.col("cognitive_p90"), (4, 10, 20, 40)), sub_score(F.col("dup_blocks"), (0, 2, 5, 10)))
    clarity = sub_score(clamp(F.col("untested_exports")), missing)
    described = F.when(F.col("documented_exports").isNull(), 2).otherwise(sub_score(clamp(F.col("exported_symbols") - F.col("documented_exports")), missing))
    return (50 - 10 * F.floor((structure + clarity + described) / 3)).cast("double")


def effective_kloc(p: RebuildParams) -> Column:
    return F.col("sloc") * (1 - F.col("duplication_pct") / 100) / 1000 * (1 + 0.02 * understanding() * p.unfamiliarity)


def complexity_rating() -> Column:
    """0 (very low) to 5 (extra high) from cognitive_p90; nominal without functions."""
    c = F.col("cognitive_p90")
    return F.when(F.col("func_count") == 0, 2).when(c <= 1, 0).when(c <= 4, 1).when(c <= 10, 2).when(c <= 20, 3).when(c <= 40, 4).otherwise(5)


def human_days(p: RebuildParams) -> tuple[Column, Column]:
    """Days under COCOMO 81 basic organic mode and under COCOMO II with the profile."""
    kloc = effective_kloc(p)
    cplx = F.element_at(F.array(*[F.lit(float(v)) for v in CPLX]), complexity_rating() + 1)
    basic = p.cocomo_a * F.pow(kloc, F.lit(p.cocomo_b)) * p.days_per_month
    return basic, p.coefficient * F.pow(kloc, F.lit(p.scale_exponent)) * cplx * p.days_per_month


def hotspot(churn: Column, passes_rounded: Column) -> Column:
    """Churn times passes rounded to one decimal; 0 where churn isn't measured."""
    return F.when(churn.isNull(), 0.0).otherwise(round_to(churn * passes_rounded, 1))


def risk_band(tier_: Column, over: Column, duplication: Column) -> Column:
    return F.when((tier_ == "PARTITION") | (over >= 2), "split").when((over == 1) | (tier_ == "FEW_PASSES") | (duplication >= 25), "watch").otherwise("fine")


def function_level(cognitive: Column) -> Column:
    return F.when(cognitive > 20, "split").when(cognitive > 10, "watch").otherwise("fine")


def set_key(items: Column) -> Column:
    """One text for a set, whatever the order and repeats of its items."""
    return F.array_join(F.array_sort(F.array_distinct(items)), "\u0000")


def readable(value: Column, percent: bool = False) -> Column:
    """Two significant figures, then the nearest step: 500 above 1000, 50 above 100, 5 above 10, else the least."""
    least = 0.5 if percent else 1.0
    mag = F.pow(F.lit(10.0), F.floor(F.log10(F.abs(value))) - 1)
    two = F.round(value / mag) * mag
    size = F.abs(two)
    step = F.when(size > 1000, 500.0).when(size > 100, 50.0).when(size > 10, 5.0).otherwise(least)
    return F.when(value == 0, 0.0).otherwise(F.round(two / step) * step)


def delta_from_iqr(iqr: Column, percent: bool = False) -> Column:
    """A quarter of the interquartile range, up to whole steps, one step at least."""
    step = 0.5 if percent else 1.0
    return F.greatest(F.ceil(iqr / 4 / step - 1e-9) * step, F.lit(step))


def module_relative(path: Column, module: Column) -> Column:
    """A package's directory in its module: '.' for the module itself; paths outside stay."""
    return F.when(path == module, ".").when(path.startswith(F.concat(module, F.lit("/"))), F.substr(path, F.length(module) + 2)).otherwise(path)


def import_path(module: Column, directory: Column) -> Column:
    return F.when(directory == ".", module).otherwise(F.concat(module, F.lit("/"), directory))


def is_below(path: Column, root: Column) -> Column:
    """A strict descendant."""
    return path.startswith(F.concat(root, F.lit("/")))


def is_stdlib(path: Column) -> Column:
    """Standard library paths have no dot in their first segment."""
    return ~F.split_part(path, F.lit("/"), F.lit(1)).contains(".")


class BadPattern(ValueError):
    """An exclude pattern that can't be read."""


def _segment_regex(segment: str) -> str:
    """One path segment of a glob: * and ? stay in it, [abc], [a-z] and [^a] are classes, a backslash escapes."""
    import re

    token = re.compile(r"(?P<star>\*)|(?P<one>\?)|\[(?P<no>\^?)(?P<set>(?:\\.|[^\]\\])+)\]|\\(?P<esc>.)|(?P<plain>[^\[\\])", re.S)
    out, at = "", 0
    while at < len(segment):
        m = token.match(segment, at)
        if m is None:
            raise BadPattern(f"malformed segment {segment!r}")
        if m["set"] is not None:
            ranges = re.findall(r"(\\.|[^\\])(?:-(\\.|[^\\]))?", m["set"], re.S)
            bare = re.sub(r"\\.", "x", m["set"], flags=re.S)
            if bare[0] == "-" or bare[-1] == "-":
                raise BadPattern(f"malformed segment {segment!r}")
            bound = lambda c: re.escape(c[-1])
            out += "[" + ("^/" if m["no"] else "") + "".join(bound(a) + (f"-{bound(b)}" if b else "") for a, b in ranges) + "]"
        else:
            out += "[^/]*" if m["star"] else "[^/]" if m["one"] else re.escape(m["esc"] or m["plain"])
        at = m.end()
    return out


def glob_regex(pattern: str) -> str:
    """An anchored regex for a path glob: ** spans segments; a match covers what is below. Patterns that are empty,
    absolute, leave the root, mix ** with other characters or have an open class are refused."""
    if not pattern.strip():
        raise BadPattern("empty pattern")
    if pattern.startswith("/"):
        raise BadPattern("pattern must be relative to the module root")
    segments = pattern.removesuffix("/").split("/")
    for s in segments:
        if s in ("", ".", ".."):
            raise BadPattern(f"segment {s!r} not allowed")
        if "**" in s and s != "**":
            raise BadPattern("** must be a whole path segment")
    parts = ["**" if s == "**" else _segment_regex(s) for s in segments]
    out = ""
    for i, s in enumerate(parts):
        if s == "**":
            out += "(?:[^/]+/)*" if i < len(parts) - 1 else ".*"
        else:
            out += s + ("/" if i < len(parts) - 1 else "")
    return f"^{out}(?:/.*)?$"


def first_match(path: Column, patterns: list[str]) -> Column:
    """The first pattern of the list that matches, null if none does."""
    return F.coalesce(*[F.when(path.rlike(glob_regex(p)), F.lit(p)) for p in patterns]) if patterns else F.lit(None).cast("string")


def is_generated(text: Column) -> Column:
    """Has the generated-file line before its package clause."""
    return F.regexp_replace(text, r"(?s)(?m)^package .*", "").rlike(r"(?m)^// Code generated .* DO NOT EDIT\.$")
