"""Readers of the formats that facts come in. Each takes rows of text, so any Spark source can feed it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LOG_SCHEMA = "v int, event string, time string, commit string, module string, package string, metric string, config_version string, block struct<kind: string, base: double, head: double, limit: string, also: array<string>>, pass struct<exists: boolean, value: double, exempted: boolean>"


def coverage_profile(lines: DataFrame, line: str = "value") -> DataFrame:
    """file, l0, c0, l1, c1, stmts, count of a profile's block lines; the mode line is skipped. The file name may
    hold colons: the last one cuts."""
    pattern = r"^(.*):(\d+)\.(\d+),(\d+)\.(\d+)\s+(\d+)\s+(\d+)\s*$"
    part = lambda i: F.regexp_extract(F.col(line), pattern, i)
    names = ("l0", "c0", "l1", "c1", "stmts", "count")
    return lines.where(F.col(line).rlike(pattern)).select(part(1).alias("file"), *[part(i + 2).cast("bigint").alias(n) for i, n in enumerate(names)])


def log_lines(lines: DataFrame, line: str = "value") -> tuple[DataFrame, DataFrame]:
    """(valid log lines, lines that are not): a bad line is set aside, never an error."""
    parsed = lines.withColumn("j", F.from_json(line, LOG_SCHEMA, {"mode": "PERMISSIVE"}))
    ok = F.col("j.event").isin("block", "pass") & F.col("j.package").isNotNull() & F.col("j.metric").isNotNull() & (F.col("j.v") == 1)
    ok = F.coalesce(ok, F.lit(False))
    rest = [c for c in lines.columns if c != line]
    return parsed.where(ok).select(*rest, "j.*"), parsed.where(~ok).select(*lines.columns)


def name_status(fields: DataFrame, text: str = "value") -> DataFrame:
    """status, old, new of NUL-separated name-status output: renames and copies have two paths."""
    entry = F.regexp_extract_all(F.col(text), F.lit("([RC][0-9]*\\x00[^\\x00]*\\x00[^\\x00]*|[ADMTU]\\x00[^\\x00]*)(?:\\x00|$)"), F.lit(1))
    e = fields.select(*[c for c in fields.columns if c != text], F.explode(entry).alias("e"))
    p = F.split("e", "\u0000")
    return e.withColumn("p", p).select(*[c for c in fields.columns if c != text], F.substring(F.col("p")[0], 1, 1).alias("status"), F.col("p")[1].alias("old"), F.try_element_at("p", F.lit(3)).alias("new")).withColumn("new", F.coalesce("new", F.when(F.col("status") != "D", F.col("old"))))


def commit_walk(records: DataFrame, text: str = "value") -> DataFrame:
    """commit, seq, author, path of log records: hash, author and paths, one to a line."""
    parts = F.split(F.trim(F.col(text)), "\n")
    r = records.withColumn("p", parts)
    return r.select("seq", F.col("p")[0].alias("commit"), F.lower(F.trim(F.col("p")[1])).alias("author"), F.explode(F.filter(F.slice("p", 3, 1_000_000), lambda x: x != "")).alias("path"))


BASELINE_SCHEMA = "ref string, generated_at string, module_path string, tokenizer string, packages map<string, map<string, double>>, package_rows map<string, struct<package_path: string>>"


def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    """package, metric, value of a baseline file. Older files key packages by import path: the module is cut off."""
    doc = spark.read.schema(BASELINE_SCHEMA).json(path, multiLine=True)
    rows = doc.select("module_path", "package_rows", F.explode("packages").alias("key", "metrics"))
    own = F.col("package_rows")[F.col("key")]["package_path"]
    old = F.when(F.col("key") == F.col("module_path"), ".").otherwise(F.regexp_replace("key", F.concat(F.lit("^\\Q"), F.col("module_path"), F.lit("/\\E")), F.lit("")))
    return rows.select(F.coalesce(own, old).alias("package"), F.explode("metrics").alias("metric", "value"))


def nearest_module(dirs: DataFrame, markers: DataFrame, directory: str = "dir") -> DataFrame:
    """Adds module: the longest marker directory that encloses each dir (null without one). Every enclosing
    directory of a dir is made from it, so it is an equality join."""
    parts = F.split(F.col(directory), "/")
    above = F.transform(F.sequence(F.lit(1), F.size("__p")), lambda i: F.array_join(F.slice("__p", 1, i), "/"))
    exploded = dirs.select(directory).distinct().withColumn("__p", parts).select(directory, F.explode(above).alias("module"))
    best = exploded.join(markers.select("module").distinct(), "module", "left_semi").groupBy(directory).agg(F.max_by("module", F.length("module")).alias("module"))
    return dirs.join(best, directory, "left")


def languages(files: DataFrame, markers: dict[str, str]) -> DataFrame:
    """root, n, language of every root of files (root, path): how many languages have a marker there, and which one if
    it is the only one."""
    name = F.element_at(F.split("path", "/"), -1)
    found = F.array_compact(F.array(*[F.when(name == marker, F.lit(lang)) for lang, marker in sorted(markers.items())]))
    rows = files.select("root", F.explode_outer(found).alias("language")).groupBy("root").agg(F.collect_set("language").alias("l"))
    return rows.select("root", F.size("l").cast("bigint").alias("n"), F.when(F.size("l") == 1, F.get("l", 0)).alias("language"))


def detect_language(files: DataFrame, markers: dict[str, str]) -> str:
    """The one language whose marker file is there; an error without one or with several."""
    got = languages(files.select(F.lit(".").alias("root"), "path"), markers).first()
    if got is None or got["n"] != 1:
        raise ValueError(f"want one language, found {got['n'] if got else 0}")
    return got["language"]


def classify_path(path: Column) -> Column:
    """source, test, marker or other, of a path."""
    name = F.element_at(F.split(path, "/"), -1)
    return (
        F.when(name.isin("go.mod", "package.json", "tsconfig.json"), "marker")
        .when(name.rlike(r"(_test\.go|\.(test|spec)\.tsx?)$") | path.rlike(r"(^|/)__tests__/"), "test")
        .when(name.rlike(r"\.(go|tsx?)$") & ~name.rlike(r"\.d\.ts$"), "source")
        .otherwise("other")
    )


def source_lines(text: Column) -> Column:
    """Lines with anything besides white space and comments (// and /* */)."""
    bare = F.regexp_replace(F.regexp_replace(text, r"(?s)/\*.*?\*/", ""), r"//[^\n]*", "")
    return F.size(F.filter(F.split(bare, "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", "")) != "")).cast("bigint")


def go_imports(text: Column) -> Column:
    """The import paths of a Go file's text, sorted and distinct."""
    single = F.regexp_extract_all(text, F.lit(r'(?m)^import\s+(?:[\w.]+\s+)?"([^"]+)"'), F.lit(1))
    block = F.regexp_extract(text, r"(?s)\bimport\s*\((.*?)\)", 1)
    grouped = F.regexp_extract_all(block, F.lit(r'"([^"]+)"'), F.lit(1))
    return F.array_sort(F.array_distinct(F.concat(single, grouped)))


def write_single(df: DataFrame, path: str) -> None:
    """A small result as one JSON file, nulls kept."""
    df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")).coalesce(1).write.mode("overwrite").text(path)


#: Directories outside every TypeScript package, and the one whose files are the tests of its parent.
OUTSIDE, TESTS_DIR, MANIFEST = ("node_modules", "dist", "build"), "__tests__", "package.json"


def typescript_files(files: DataFrame) -> DataFrame:
    """path, package, is_test of the TypeScript files (path, from the module root) that belong to the module:
    declaration files, files under directories outside every package, and files of modules below the root are left
    out. A file meets the manifests of the directories it lies in by equality."""
    path = F.col("path")
    parts = F.split(path, "/")
    above = F.transform(F.sequence(F.lit(1), F.size("__d")), lambda n: F.array_join(F.slice("__d", F.lit(1), n), "/"))
    source = path.rlike(r"\.[mc]?tsx?$") & ~path.rlike(r"\.[mc]tsx$") & ~path.rlike(r"\.d\.[mc]?ts$")
    inside = files.select("path").distinct().where(source).withColumn("__d", F.slice(parts, F.lit(1), F.size(parts) - 1))
    inside = inside.where(~F.exists("__d", lambda s: s.isin(*OUTSIDE) | s.startswith(".")))
    nested = files.where(path.endswith("/" + MANIFEST)).select(F.regexp_replace(path, "/[^/]*$", "").alias("root")).distinct()
    own = inside.withColumn("root", F.explode_outer(F.when(F.size("__d") > 0, above)))
    foreign = own.join(nested, "root", "left_semi").select("path").distinct()
    cut = F.array_position("__d", TESTS_DIR)
    package = F.array_join(F.when(cut > 0, F.slice("__d", F.lit(1), (cut - 1).cast("int"))).otherwise(F.col("__d")), "/")
    test = path.rlike(r"\.(test|spec)\.([mc]ts|tsx?)$") | (cut > 0)
    return inside.join(foreign, "path", "left_anti").select("path", F.when(package == "", ".").otherwise(package).alias("package"), test.alias("is_test"))


def guessed_names(path: Column) -> Column:
    """The names an unnamed import of a path may give: its last part, without a version part or suffix, and without go
    around a dash."""
    parts = F.split(path, "/")
    last = F.element_at(parts, -1)
    name = F.when((F.size(parts) > 1) & last.rlike(r"^v\d+$"), F.element_at(parts, F.when(F.size(parts) > 1, -2).otherwise(-1))).otherwise(last)
    name = F.regexp_replace(name, r"\.v\d+$", "")
    bare = F.regexp_replace(F.regexp_replace(name, "^go-", ""), "-go$", "")
    return F.array_distinct(F.array(name, bare))


def selectors(text: Column) -> Column:
    """The `pkg.Name` selectors of a text, distinct and in order: what a test of a package that doesn't load refers to
    by name."""
    bare = F.regexp_replace(F.regexp_replace(text, r'"(?:[^"\\\\\n]|\\\\.)*"|`[^`]*`', '""'), r"//[^\n]*|(?s:/\*.*?\*/)", " ")
    return F.array_sort(F.array_distinct(F.regexp_extract_all(bare, F.lit(r"\b([A-Za-z_]\w*\.[A-Z]\w*)"), F.lit(1))))
