"""Packages from facts: which files count, what is left out, assembly, linking, seeding from renames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.scalar import first_match


def authored(files: DataFrame) -> DataFrame:
    """Adds kind to files (package, file, is_test, generated): test, generated or source; only source is authored."""
    return files.withColumn("kind", F.when(F.col("is_test"), "test").when(F.col("generated"), "generated").otherwise("source"))


def not_analysed(files: DataFrame, errors: DataFrame) -> DataFrame:
    """package, reason of packages that aren't measured: those with a load error (the first by ord), and those none of
    whose files is built."""
    bad = errors.groupBy("package").agg(F.min_by("reason", "ord").alias("reason"))
    unbuilt = files.groupBy("package").agg(F.bool_and(~F.col("built")).alias("none")).where("none").select("package", F.lit("no file is built").alias("reason"))
    return bad.unionByName(unbuilt.join(bad, "package", "left_anti"))


def skipped_report(skipped: DataFrame, excluded: DataFrame, selected: DataFrame) -> DataFrame:
    """package, reason, selected: skipped and excluded packages together; only a skipped one can be selected."""
    asked = selected.select("package").distinct().withColumn("asked", F.lit(True))
    s = skipped.join(asked, "package", "left").select("package", "reason", F.coalesce("asked", F.lit(False)).alias("selected"))
    return s.unionByName(excluded.select("package", "reason", F.lit(False).alias("selected")))


def selection(head: DataFrame, skipped: DataFrame, changed: DataFrame) -> DataFrame:
    """What a check of every package selects: all that load, and skipped ones whose own files changed."""
    loaded = head.select("package").distinct().join(skipped.select("package"), "package", "left_anti")
    return loaded.union(skipped.select("package").distinct().join(changed.select("package").distinct(), "package", "left_semi"))


def excluded_packages(files: DataFrame, patterns: list[str]) -> DataFrame:
    """package, gone, pattern: whether every non-test file of a package is excluded, and the first pattern of the list
    that matched one of them."""
    hit = files.where("not is_test").withColumn("pattern", first_match(F.col("path"), patterns))
    place = F.array_position(F.array(*map(F.lit, patterns)), F.col("pattern"))
    out = hit.groupBy("package").agg(F.bool_and(F.col("pattern").isNotNull()).alias("gone"), F.min_by("pattern", F.when(F.col("pattern").isNotNull(), place)).alias("pattern"))
    return out.where("pattern is not null")


def assemble(parts: list[DataFrame], packages: DataFrame, zeros: dict[str, int | float]) -> DataFrame:
    """One row for each package from frames of metrics by package: a frame without the package leaves its metrics at
    zero where `zeros` says so, else unknown. Each part is aggregated to packages before it is joined."""
    out = packages.select("package").distinct()
    for part in parts:
        out = out.join(part, "package", "left")
    return out.fillna(zeros)


def global_counts(variables: DataFrame) -> DataFrame:
    """package, globals, init_funcs from facts (package, name, kind, mutable, written): variables that can change and
    do, and init functions."""
    changes = (F.col("kind") == "var") & F.col("mutable") & F.col("written")
    return variables.groupBy("package").agg(F.count_if(changes).alias("globals"), F.count_if(F.col("kind") == "init").alias("init_funcs"))


def snapshot(tables: dict[str, DataFrame], path: str, version: str) -> None:
    """Writes each fact table of a snapshot under its version; a version that is written again replaces itself only."""
    for name, rows in tables.items():
        rows.withColumn("snapshot", F.lit(version)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("snapshot").parquet(f"{path}/{name}")


def read_snapshot(spark, path: str, name: str, version: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}").where(F.col("snapshot") == version).drop("snapshot")


def carved_edges(edges: DataFrame, renames: DataFrame, base: DataFrame) -> DataFrame:
    """(importer, package) at head for every package that renames carved out (it has no base row) or carved from."""
    new = renames.join(base.select("package"), "package", "left_anti")
    ends = new.select("package").union(new.select(F.col("source").alias("package"))).distinct()
    return edges.select(F.col("source").alias("importer"), F.col("target").alias("package")).distinct().join(ends, "package", "left_semi").select("importer", "package")


def carried(renames: DataFrame, base: DataFrame, head_edges: DataFrame, base_edges: DataFrame) -> DataFrame:
    """(importer, package): imports of carved-out packages that are no rise: by one of the sources, or by a package
    that imported a source at base and imports both it and the carved-out package at head."""
    new = renames.join(base.select("package"), "package", "left_anti").select("package", "source").distinct()
    now = carved_edges(head_edges, renames, base)
    direct = new.select("package", F.col("source").alias("importer")).join(now, ["package", "importer"], "left_semi").select("importer", "package")
    before = base_edges.select(F.col("source").alias("importer"), F.col("target").alias("source")).distinct()
    through = new.join(before, "source").where("importer <> package")
    through = through.join(new.select("package", F.col("source").alias("importer")), ["package", "importer"], "left_anti")
    through = through.join(now, ["importer", "package"], "left_semi").join(now.withColumnRenamed("package", "source"), ["importer", "source"], "left_semi")
    return direct.union(through.select("importer", "package")).distinct()


def seeded(head: DataFrame, base: DataFrame, renames: DataFrame, carried_: DataFrame, head_edges: DataFrame) -> DataFrame:
    """package, sources, metrics: the baseline row of each head package: its own with the carried imports added to
    internal_imports, or that of the rename source most files came from, with fan_in raised by the sources that
    import the package at head. base: package, fan_in, internal_imports, sloc. renames: package, source, files."""
    metrics = [c for c in base.columns if c != "package"]
    more = carried_.groupBy(F.col("importer").alias("package")).agg(F.count_distinct(F.col("package")).alias("more"))
    own = head.select("package").distinct().join(base, "package").join(more, "package", "left")
    own = own.withColumn("internal_imports", F.col("internal_imports") + F.coalesce("more", F.lit(0))).select("package", F.lit(None).cast("string").alias("sources"), *metrics)
    new = head.select("package").distinct().join(base.select("package"), "package", "left_anti")
    have = renames.join(new, "package", "left_semi").join(base.withColumnRenamed("package", "source"), "source")
    uses = head_edges.select(F.col("source"), F.col("target").alias("package")).distinct().withColumn("uses", F.lit(1))
    have = have.join(uses, ["source", "package"], "left")
    seed = have.groupBy("package").agg(F.min_by(F.struct(*metrics), F.struct(-F.col("files"), "source")).alias("m"), F.array_join(F.array_sort(F.collect_set(F.col("source").cast("string"))), ",").alias("sources"), F.sum(F.coalesce("uses", F.lit(0))).alias("uses"))
    seed = seed.select("package", "sources", *[F.col(f"m.{c}").alias(c) for c in metrics], "uses").withColumn("fan_in", F.col("fan_in") + F.col("uses")).drop("uses")
    return own.unionByName(seed)


def fact_rows(head: DataFrame, base: DataFrame, findings: DataFrame, unavailable: DataFrame) -> DataFrame:
    """package, new, baseline, sloc_delta, violations, passed of every checked package. findings: package, kind,
    reason (null: not exempted)."""
    bad = findings.where("kind = 'violation' and reason is null").groupBy("package").agg(F.count("*").alias("violations"))
    met = head.select("package", "sloc").join(base.select("package", F.col("sloc").alias("had")), "package", "left").join(bad, "package", "left").join(unavailable.select("package").distinct().withColumn("u", F.lit(True)), "package", "left")
    n = F.coalesce("violations", F.lit(0))
    return met.select("package", F.col("had").isNull().alias("new"), F.when(F.col("u"), "unavailable").otherwise("parent").alias("baseline"), (F.col("sloc") - F.coalesce("had", F.lit(0))).alias("sloc_delta"), n.alias("violations"), (n == 0).alias("passed"))


def recorded_functions(changed: DataFrame, floor: int = 20) -> DataFrame:
    """Changed functions (package, name, cognitive, base_cognitive) over the floor: those a sweep can judge."""
    return changed.where(F.col("cognitive") > floor)


def linked(imports: DataFrame, exports: DataFrame) -> DataFrame:
    """source, target, name of imports (source, specifier_package, name) resolved through re-exports.

    exports: package, name, origin (the package a name is re-exported from, null if its own). One hop: a name that
    a package re-exports links to the origin; others link to the package named."""
    e = exports.where("origin is not null").select(F.col("package").alias("specifier_package"), "name", "origin").distinct()
    met = imports.join(e, ["specifier_package", "name"], "left")
    return met.select("source", F.coalesce("origin", "specifier_package").alias("target"), "name").where("source <> target").distinct()


def role(is_main: Column, files: Column, authored_files: Column, support: Column) -> Column:
    """main, generated-only (files, none of them authored), test-support, library: the first that holds."""
    return F.when(is_main, "main").when((files > 0) & (authored_files == 0), "generated-only").when(support, "test-support").otherwise("library")


def validation_errors(rows: DataFrame, shares: list[str], counts: list[str]) -> DataFrame:
    """package, problem of every metric out of range and every cross-field rule a row breaks. Unknown values pass."""
    c = set(rows.columns)
    tests = [(f"{m} < 0", f"{m} is negative") for m in counts if m in c]
    tests += [(f"{m} < 0 or {m} > 100 or isnan({m})", f"{m} outside [0, 100]") for m in shares if m in c]
    for small, large in (("largest_file_sloc", "sloc"), ("tokens_est", "tokens_est_with_tests"), ("documented_exports", "exported_symbols"), ("internal_imports_descendants", "internal_imports")):
        if {small, large} <= c:
            tests.append((f"{small} > {large}", f"{small} exceeds {large}"))
    if {"tokens_est_generated", "generated_files"} <= c:
        tests.append(("tokens_est_generated > 0 and generated_files = 0", "tokens_est_generated with generated_files 0"))
    if "internal_imports_private" in c:
        bound = "coalesce(internal_imports_descendants, internal_imports)" if "internal_imports_descendants" in c else "internal_imports"
        tests.append((f"internal_imports_private > {bound}", "internal_imports_private exceeds what it is part of"))
    found = F.array_compact(F.array(*[F.when(F.coalesce(F.expr(t), F.lit(False)), F.lit(m)) for t, m in tests]))
    return rows.select("package", F.explode(found).alias("problem"))
