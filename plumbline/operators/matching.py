"""Joins and matching: multisets, canonical sets, intervals, look-ahead, as-of, graphs, components."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.scalar import set_key
from plumbline.sources.shared import shared_path, written


def numbered(rows: DataFrame, key: list[str], order: list, name: str = "k") -> DataFrame:
    """Adds the place of each row among those of its key, from 1."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*key).orderBy(*order)))


def changed_functions(head: DataFrame, base: DataFrame, name: list[str]) -> DataFrame:
    """Head functions without an equal base function, with the base value of their name's k-th leftover.

    head and base: name columns, fingerprint, ord, value. Copies match one to one, in order. Adds base_value
    (null for a new function). A name or fingerprint with very many copies is one window partition; names are
    scoped by package, which bounds them.
    """
    key = [*name, "fingerprint"]
    h, b = numbered(head, key, ["ord"]), numbered(base, key, ["ord"])
    changed = h.join(b.select(*key, "k"), [*key, "k"], "left_anti").drop("k")
    left = b.join(h.select(*key, "k"), [*key, "k"], "left_anti").drop("k")
    c, l = numbered(changed, name, ["ord"]), numbered(left, name, ["ord"])
    return c.join(l.select(*name, "k", F.col("value").alias("base_value")), [*name, "k"], "left").drop("k")


def excess(head: DataFrame, base: DataFrame, key: str) -> DataFrame:
    """Head rows beyond base's number of the same key: the later ones in head's order. Adds is_new."""
    had = base.groupBy(key).agg(F.count("*").alias("had"))
    placed = numbered(head, [key], ["ord"])
    return placed.join(had, key, "left").withColumn("is_new", F.col("k") > F.coalesce("had", F.lit(0))).drop("k", "had")


def without_either(head: DataFrame, base: DataFrame, first: str, second: str) -> DataFrame:
    """Head rows whose two anchors are both absent from base's column `anchor`."""
    known = base.select(F.col("anchor")).distinct()
    out = head.join(known.withColumnRenamed("anchor", first), first, "left_anti")
    return out.join(known.withColumnRenamed("anchor", second), second, "left_anti")


def signature_changes(head: DataFrame, base: DataFrame) -> DataFrame:
    """Head (package, name, sig) whose name has signatures at base, none of them equal."""
    names = base.select("package", "name").distinct()
    return head.join(names, ["package", "name"], "left_semi").join(base.select("package", "name", "sig").distinct(), ["package", "name", "sig"], "left_anti")


def made_private(head: DataFrame, base: DataFrame) -> DataFrame:
    """Base exports (package, name) that are gone where head has the name in lower case: the first such."""
    gone = base.join(head.select("package", "name"), ["package", "name"], "left_anti")
    now = head.select("package", F.col("name").alias("now"), F.lower("name").alias("low"), "ord")
    met = gone.select("package", "name", F.lower("name").alias("low")).join(now, ["package", "low"])
    return met.groupBy("package", "name").agg(F.min(F.struct("ord", "now")).alias("m")).select("package", "name", F.col("m.now").alias("now"))


def fan_in(edges: DataFrame) -> DataFrame:
    """package, fan_in, fan_in_tests of distinct edges (source, target, test): a test edge counts unless the
    pair is imported without tests too, or is the package itself."""
    plain = edges.where("not test").select("source", "target").distinct()
    tests = edges.where("test and source <> target").select("source", "target").distinct().join(plain, ["source", "target"], "left_anti")
    both = plain.select("target", F.lit(1).alias("p"), F.lit(0).alias("t")).unionAll(tests.select("target", F.lit(0), F.lit(1)))
    return both.groupBy(F.col("target").alias("package")).agg(F.sum("p").alias("fan_in"), F.sum("t").alias("fan_in_tests"))


def import_class(path: Column, module: Column) -> Column:
    """internal under the module, external with a dot in the first segment, else stdlib."""
    return F.when((path == module) | path.startswith(F.concat(module, F.lit("/"))), "internal").when(F.split_part(path, F.lit("/"), F.lit(1)).contains("."), "external").otherwise("stdlib")


def contained(inner: DataFrame, outer: DataFrame, key: list[str], span: int) -> DataFrame:
    """Pairs of inner (lo, hi) inside outer (from, to) of the same key. Both sides are cut to slots of `span`, so
    the join is an equality and a slot holds what begins in it; outer stretches stand in each slot they reach."""
    i = inner.withColumn("slot", F.floor(F.col("lo") / span))
    o = outer.withColumn("slot", F.explode(F.sequence(F.floor(F.col("from") / span), F.floor(F.col("to") / span))))
    return i.join(o, [*key, "slot"]).where((F.col("lo") >= F.col("from")) & (F.col("hi") <= F.col("to"))).drop("slot")


def first_within(rows: DataFrame, later: DataFrame, key: list[str], window: int) -> DataFrame:
    """For each row (key, seq) the first later row (key, seq) at most `window` after it; null without one.

    Slots of the window's length make it an equality join of each row with two slots."""
    r = rows.withColumn("slot", F.explode(F.array(F.floor(F.col("seq") / window), F.floor(F.col("seq") / window) + 1)))
    l = later.select(*key, F.col("seq").alias("next"), F.floor(F.col("seq") / window).alias("slot"))
    met = r.join(l, [*key, "slot"]).where((F.col("next") > F.col("seq")) & (F.col("next") <= F.col("seq") + window))
    best = met.groupBy(*key, "seq").agg(F.min("next").alias("next"))
    return rows.join(best, [*key, "seq"], "left")


def as_of(rows: DataFrame, facts: DataFrame, key: list[str], value: str) -> DataFrame:
    """Adds to rows (key, seq) the value of the latest fact (key, seq, value) strictly before; null without one.

    One sort of the union by key and seq, no pairs. A hot key is one window partition, which spills."""
    f = facts.select(*key, "seq", F.col(value).alias("__v"), F.lit(1).alias("__o"))
    r = rows.withColumn("__v", F.lit(None).cast(facts.schema[value].dataType)).withColumn("__o", F.lit(0))
    both = r.unionByName(f, allowMissingColumns=True)
    w = Window.partitionBy(*key).orderBy("seq", "__o").rowsBetween(Window.unboundedPreceding, -1)
    return both.withColumn(value, F.last("__v", ignorenulls=True).over(w)).where("__o = 0").drop("__v", "__o")


def changed_packages(diff: DataFrame, head: DataFrame, base: DataFrame) -> DataFrame:
    """package, state: touched packages with files at head are changed, others that base had are deleted."""
    touched = diff.select("package").distinct()
    state = touched.join(head.select("package").distinct().withColumn("h", F.lit(True)), "package", "left").join(base.select("package").distinct().withColumn("b", F.lit(True)), "package", "left")
    return state.select("package", F.when(F.col("h"), "changed").when(F.col("b"), "deleted").alias("state")).where("state is not null")


def importers(edges: DataFrame, changed: DataFrame) -> DataFrame:
    """Packages that import a changed one and aren't changed themselves."""
    hit = edges.join(changed.select(F.col("package").alias("target")).distinct(), "target", "left_semi").select(F.col("source").alias("package")).distinct()
    return hit.join(changed.select("package").distinct(), "package", "left_anti")


def min_labels(vertices: DataFrame, edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(id, component): the smallest id reachable over undirected edges (a, b), by label propagation with pointer
    jumping. Labels are checkpointed to the shared folder each round, so lineage stays short."""
    both = edges.select("a", "b").unionAll(edges.select(F.col("b"), F.col("a"))).where("a <> b").distinct()
    labels = vertices.select("id", F.col("id").alias("component")).checkpoint()
    for _ in range(rounds):
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("m"))
        low = labels.join(near, "id", "left").select("id", "component", F.least("component", F.coalesce("m", "component")).alias("n"))
        jump = labels.select(F.col("id").alias("n"), F.col("component").alias("j"))
        after = low.join(jump, "n", "left").select("id", F.least("n", F.coalesce("j", "n")).alias("component"), (F.least("n", F.coalesce("j", "n")) != F.col("component")).alias("moved")).checkpoint()
        labels = after.select("id", "component")
        if after.where("moved").isEmpty():
            return labels
    raise RuntimeError("chains too long for the given number of rounds")


def seeded_rows(head: DataFrame, base: DataFrame, renames: DataFrame, metrics: list[str]) -> DataFrame:
    """Baseline rows for head packages: their own, else the row of the first ranked rename source that has one.

    renames: package, source, files. Most files first, ties by source."""
    have = renames.join(base.select(F.col("package").alias("source"), *metrics), "source")
    best = have.groupBy("package").agg(F.min_by(F.struct("source", *metrics), F.struct(-F.col("files"), "source")).alias("s"))
    own = base.select("package", F.struct(F.lit(None).cast(renames.schema["source"].dataType).alias("source"), *metrics).alias("o"))
    met = head.select("package").join(own, "package", "left").join(best, "package", "left")
    pick = F.when(F.col("o").isNotNull(), F.col("o")).otherwise(F.col("s"))
    return met.select("package", pick.alias("r")).where("r is not null").select("package", F.col("r.source").alias("source"), *[F.col(f"r.{m}").alias(m) for m in metrics])


def rank_sources(pairs: DataFrame) -> DataFrame:
    """package, source, files, place of rename pairs (package, source), most files first, ties by source."""
    counts = pairs.groupBy("package", "source").agg(F.count("*").alias("files"))
    return counts.withColumn("place", F.row_number().over(Window.partitionBy("package").orderBy(F.col("files").desc(), "source")))


def grouped_sets(rows: DataFrame, group: str, item: str) -> DataFrame:
    """group, set_key: the canonical key of each group's items."""
    return rows.groupBy(group).agg(F.collect_set(item).alias("items")).select(group, set_key(F.col("items")).alias("set_key"))


#: Packages are broadcast up to this many (16 MB of numbers), and joined by a shuffle beyond.
BROADCAST_PACKAGES = 1_000_000


def reaching(edges: DataFrame, targets: DataFrame, rounds: int = 100) -> DataFrame:
    """Packages from which a target is reached over edges (source, target), targets included.

    The edges are written once, repeats and all, and what each round adds to a folder of its own. A round reads both;
    while the last one added few, neither the edges nor the packages known are shuffled."""
    spark = edges.sparkSession
    edges = written(edges.select("source", "target"), "edges")
    path = f"{shared_path(spark)}/plumbline-reached-{uuid.uuid4().hex}"
    kind = targets.schema["package"].dataType.simpleString()
    few = lambda df: F.broadcast(df) if df.limit(BROADCAST_PACKAGES + 1).count() <= BROADCAST_PACKAGES else df
    read = lambda at="": spark.read.schema(f"package {kind}").option("recursiveFileLookup", "true").parquet(f"{path}{at}")
    targets.select("package").distinct().write.parquet(f"{path}/0")
    for i in range(rounds):
        front = few(read(f"/{i}").withColumnRenamed("package", "target"))
        met = written(edges.join(front, "target", "left_semi").select(F.col("source").alias("package")).distinct(), "met")
        had = read().join(few(met), "package", "left_semi")
        met.join(few(had), "package", "left_anti").write.parquet(f"{path}/{i + 1}")
        if read(f"/{i + 1}").isEmpty():
            return read()
    raise RuntimeError("paths too long for the given number of rounds")
