"""What a change did to exported surfaces and tests: reshaped exports, untested exports, where findings are shown.

Everything is equality joins over facts; nothing here parses source.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.scalar import EPSILON


def qualified(receiver: Column, name: Column) -> Column:
    return F.when(F.coalesce(receiver, F.lit("")) == "", name).otherwise(F.concat(receiver, F.lit("."), name))


def signature_changes(head: DataFrame, base: DataFrame) -> DataFrame:
    """Distinct head functions (package, receiver, name, signature) whose name has signatures at base, none of them its own."""
    key = ["package", "receiver", "name"]
    h, b = (x.where("signature is not null").select(*key, "signature").distinct() for x in (head, base))
    return h.join(b.select(*key).distinct(), key, "left_semi").join(b, [*key, "signature"], "left_anti")


def made_unexported(exports: DataFrame, unexported: DataFrame, base: DataFrame) -> DataFrame:
    """Base exports (package, kind, receiver, name) that head doesn't export while it has an unexported symbol of
    the same kind and receiver whose name is the same ignoring case: the first by ord, as `now`."""
    gone = base.select("package", "kind", "receiver", "name").distinct().join(exports.select("package", "receiver", "name").distinct(), ["package", "receiver", "name"], "left_anti")
    low = unexported.groupBy("package", "kind", "receiver", F.lower("name").alias("low")).agg(F.min_by("name", "ord").alias("now"))
    return gone.withColumn("low", F.lower("name")).join(low, ["package", "kind", "receiver", "low"]).drop("low")


def reshaped(changes: DataFrame, hidden: DataFrame) -> DataFrame:
    """package, names: the changed signatures, then the exports made unexported, each sorted by qualified name."""
    q = qualified(F.col("receiver"), F.col("name"))
    first = changes.select("package", F.lit(0).alias("part"), q.alias("q"), F.concat(q, F.lit(" (signature changed)")).alias("text"))
    second = hidden.select("package", F.lit(1).alias("part"), q.alias("q"), F.concat(q, F.lit(" (unexported as "), F.col("now"), F.lit(")")).alias("text"))
    rows = first.unionAll(second).groupBy("package").agg(F.array_sort(F.collect_list(F.struct("part", "q", "text"))).alias("t"))
    return rows.select("package", F.transform("t", lambda x: x["text"]).alias("names"))


def listed(names: Column, most: int = 5) -> Column:
    """The first names as a sentence part: all but the last with commas, or `and N more`."""
    shown, more = F.slice(names, 1, most), F.size(names) - most
    last = F.element_at(shown, -1)
    joined = F.when(F.size(shown) == 1, last).otherwise(F.concat(F.array_join(F.slice(shown, F.lit(1), F.size(shown) - 1), ", "), F.lit(" and "), last))
    return F.when(more > 0, F.concat(F.array_join(shown, ", "), F.lit(" and "), more.cast("string"), F.lit(" more"))).otherwise(joined)


def in_warn_band(head: Column, base: Column, limit: float, warn_at: float) -> Column:
    """Near or over a ceiling, with a baseline to compare with."""
    return base.isNotNull() & ((head > limit + EPSILON) | (head >= warn_at * limit - EPSILON))


def covered_base(rows: DataFrame, base_names: DataFrame, covered: DataFrame) -> DataFrame:
    """Adds base_covered: the baseline's own figure where it has one, or, where head ran its tests and the baseline
    recorded names, how many of the baseline's untested exports head's run didn't execute.

    rows: package, head_covered, base_covered, has_named. base_names and covered: package, name."""
    left = base_names.join(covered.select("package", "name").distinct(), ["package", "name"], "left_anti").groupBy("package").agg(F.count("*").alias("still"))
    estimate = F.col("head_covered").isNotNull() & F.col("base_covered").isNull() & F.col("has_named")
    return rows.join(left, "package", "left").withColumn("base_covered", F.when(estimate, F.coalesce("still", F.lit(0))).otherwise(F.col("base_covered"))).drop("still")


def covered_last(names: DataFrame, covered: DataFrame) -> DataFrame:
    """Adds ran and place: names (package, ord, name) that no run executed come first, each part in its order."""
    ran = covered.select("package", "name").distinct().withColumn("ran", F.lit(True))
    rows = names.join(ran, ["package", "name"], "left").withColumn("ran", F.coalesce("ran", F.lit(False)))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("package").orderBy("ran", "ord")))


def located(findings: DataFrame, candidates: DataFrame, changed: DataFrame, sources: DataFrame) -> DataFrame:
    """Adds file and line to findings (package, metric, lead): the first candidate in a changed file, else the first;
    with lead the first as it is; without any, doc.go or else the package's first source file, line 1.

    candidates: package, metric, ord, file, line (no file: skipped). changed, sources: package, file (sources: ord)."""
    touched = changed.select("package", "file").distinct().withColumn("touched", F.lit(True))
    known = candidates.where("file is not null and file <> ''").join(touched, ["package", "file"], "left").withColumn("untouched", F.col("touched").isNull())
    at = F.struct("file", "line")
    best = known.groupBy("package", "metric").agg(F.min_by(at, F.struct("untouched", "ord", "file", "line")).alias("near"), F.min_by(at, F.struct("ord", "file", "line")).alias("first"))
    fall = sources.groupBy("package").agg(F.min_by("file", F.struct(F.col("file") != "doc.go", F.col("ord"), F.col("file"))).alias("fall"))
    met = findings.join(best, ["package", "metric"], "left").join(fall, "package", "left")
    spot = F.when(F.col("lead"), F.col("first")).otherwise(F.col("near"))
    return met.select(*findings.columns, F.coalesce(spot["file"], F.col("fall")).alias("file"), F.when(spot.isNotNull(), spot["line"]).when(F.col("fall").isNotNull(), F.lit(1)).alias("line"))


def span(text: Column) -> Column:
    """`file:start-end` as (file, start, stop); null where it isn't one."""
    shape = r"(?s)^(.+):([+]?\d+)-([+-]?\d+)$"
    part = lambda i: F.regexp_extract(text, shape, i)
    return F.when(text.rlike(shape), F.struct(part(1).alias("file"), part(2).try_cast("bigint").alias("start"), part(3).try_cast("bigint").alias("stop")))


@dataclass(frozen=True)
class UntestedRules:
    """Which references make an export tested, and what is left out besides."""

    others: bool = True
    support: bool = True
    std: bool = True
    options: bool = True
    held: bool = True


def untested_exports(exports: DataFrame, refs: DataFrame, std: DataFrame, dispatch: DataFrame, held: DataFrame, implements: DataFrame, rules: UntestedRules = UntestedRules()) -> DataFrame:
    """package, key, state, by_support of every counted export; `untested` is what the metric counts.

    exports: package, key, receiver, name, generated, excluded, option, receiver_exported. refs: package, key,
    origin (own, other or support). std: package, key of methods a closed standard interface covers. dispatch and
    held: name, interface, under, support (method called or held through an interface in tests of `under`).
    implements: package, receiver, interface. The first that holds is the state: tested, std, dispatched, option,
    held, untested."""
    counted = exports.where("not generated and not excluded")
    wanted = ["own", *(["other"] if rules.others else []), *(["support"] if rules.support else [])]
    by_ref = refs.where(F.col("origin").isin(*wanted)).groupBy("package", "key").agg(F.bool_and(F.col("origin") == "support").alias("only_support"))
    methods = counted.where("receiver <> ''").select("package", "key", "receiver", "name", "receiver_exported")

    def reached(index: DataFrame, label: str) -> DataFrame:
        known = index.select("name", "interface", "under", "support").distinct()
        own = F.col("under") == F.col("package")
        allowed = own | (F.lit(rules.others) & ~F.col("support")) if not rules.support else own | F.lit(rules.others)
        met = methods.join(known, "name").where(allowed).join(implements.distinct(), ["package", "receiver", "interface"])
        return met.groupBy("package", "key").agg(F.bool_and("support").alias(f"{label}_support"))

    out = counted.join(by_ref, ["package", "key"], "left").join(reached(dispatch, "dispatch"), ["package", "key"], "left").join(reached(held, "held"), ["package", "key"], "left")
    out = out.join(std.select("package", "key").distinct().withColumn("covered", F.lit(True)), ["package", "key"], "left")
    method = F.col("receiver") != ""
    state = (
        F.when(F.col("only_support").isNotNull(), "tested")
        .when(method & F.col("covered") & F.lit(rules.std), "std")
        .when(F.col("dispatch_support").isNotNull(), "dispatched")
        .when(F.col("option") & F.lit(rules.options), "option")
        .when(method & ~F.col("receiver_exported") & F.col("held_support").isNotNull() & F.lit(rules.held), "held")
        .otherwise("untested")
    )
    support = F.coalesce(F.when(state == "tested", F.col("only_support")).when(state == "dispatched", F.col("dispatch_support")), F.lit(False))
    return out.select("package", "key", state.alias("state"), support.alias("by_support"))


def untested_by_name(exports: DataFrame, identifiers: DataFrame) -> DataFrame:
    """Exports (package, name) whose name is none of the identifiers (name) that any test file of the module has."""
    return exports.select("package", "name").distinct().join(identifiers.select("name").distinct(), "name", "left_anti").select("package", "name")


def reference_origins(refs: DataFrame, support: DataFrame) -> DataFrame:
    """Adds origin to refs (under, package, key): own, support where the test is a support package's, other."""
    s = support.select(F.col("package").alias("under")).distinct().withColumn("helps", F.lit(True))
    origin = F.when(F.col("under") == F.col("package"), "own").when(F.col("helps"), "support").otherwise("other")
    return refs.join(s, "under", "left").withColumn("origin", origin).drop("helps")


def support_packages(edges: DataFrame, refs: DataFrame) -> DataFrame:
    """Packages that another package's test refers to and no non-test file of the module imports.

    edges: source, target of non-test imports. refs: under, package of test references."""
    used = refs.where("under <> package").select("package").distinct()
    return used.join(edges.select(F.col("target").alias("package")).distinct(), "package", "left_anti")
