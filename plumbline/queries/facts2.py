"""Packages from facts: selection of files, skipped packages, assembly, linking, seeding, fact rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import scalar as S
from plumbline.operators import packages as K
from plumbline.queries.registry import registry
from plumbline.sources.host import CUT, METRICS, metrics_sql, package_metrics, table
from plumbline.sources.shared import ensure_shared, shared_path

QUERIES, SQL, query = registry()

_FILE = ["l_suppkey AS package", "l_orderkey AS file", "l_linenumber % 3 = 0 AS is_test", "l_partkey % 17 = 0 AS generated", "l_partkey % 40 <> 1 OR l_suppkey % 9 <> 0 AS built"]


@query(f"SELECT package, count(*) FILTER (NOT is_test AND NOT generated) AS source, count(*) FILTER (is_test) AS test, count(*) FILTER (generated AND NOT is_test) AS generated FROM (SELECT {', '.join(_FILE)} FROM lineitem) GROUP BY package")
def s6_file_kinds(spark, d):
    """A package's files by kind; only source files are authored."""
    rows = K.authored(table(spark, d, "lineitem").selectExpr(*_FILE))
    count = lambda k: F.count_if(F.col("kind") == k).alias(k)
    return rows.groupBy("package").agg(count("source"), count("test"), count("generated"))


_ERR = "SELECT c_nationkey * 3 AS package, 'error ' || (c_custkey % 5) AS reason, c_custkey AS ord FROM customer WHERE c_acctbal < 0"
_UNB = "SELECT o_custkey AS package FROM orders GROUP BY o_custkey HAVING bool_and(o_orderstatus = 'F')"


@query(f"WITH b AS (SELECT package, arg_min(reason, ord) AS reason FROM ({_ERR}) GROUP BY package) SELECT * FROM b UNION ALL SELECT package, 'no file is built' FROM ({_UNB}) WHERE package NOT IN (SELECT package FROM b)")
def s7_not_analysed(spark, d):
    """Packages that don't load, by their first error, and those none of whose files is built."""
    errors = table(spark, d, "customer").where("c_acctbal < 0").selectExpr("c_nationkey * 3 AS package", "'error ' || (c_custkey % 5) AS reason", "c_custkey AS ord")
    return K.not_analysed(table(spark, d, "orders").selectExpr("o_custkey AS package", "o_orderstatus <> 'F' AS built"), errors)


_SK = "SELECT DISTINCT s_suppkey AS package, 'broken' AS reason FROM supplier WHERE s_acctbal < 0"
_CH = f"SELECT DISTINCT l_suppkey AS package FROM lineitem WHERE l_shipdate >= TIMESTAMP '2001-09-01 00:00:00'"


def _skips(spark, d):
    skipped = table(spark, d, "supplier").where("s_acctbal < 0").selectExpr("s_suppkey AS package", "'broken' AS reason")
    changed = table(spark, d, "lineitem").where("l_shipdate >= TIMESTAMP '2001-09-01 00:00:00'").selectExpr("l_suppkey AS package")
    return skipped, changed


@query(f"WITH s AS ({_SK}), c AS ({_CH}) SELECT s_suppkey AS package FROM supplier WHERE s_suppkey NOT IN (SELECT package FROM s) UNION ALL SELECT package FROM s WHERE package IN (SELECT package FROM c)")
def r30_selection(spark, d):
    """A check of every package selects what loads, and skipped packages whose own files changed."""
    skipped, changed = _skips(spark, d)
    return K.selection(table(spark, d, "supplier").selectExpr("s_suppkey AS package"), skipped, changed)


@query(f"WITH s AS ({_SK}), c AS ({_CH}) SELECT package, reason, package IN (SELECT package FROM c) AS selected FROM s UNION ALL SELECT n_nationkey + 100000, 'excluded', false FROM nation")
def r30_skipped_report(spark, d):
    """Skipped and excluded packages, and whether the check had selected them."""
    skipped, changed = _skips(spark, d)
    return K.skipped_report(skipped, table(spark, d, "nation").selectExpr("n_nationkey + 100000 AS package", "'excluded' AS reason"), changed)


_GLOBS = ["*/fr/**", "**/1*", "shop?/[d-e]*"]


@query(
    "WITH f AS (SELECT page_id % 60 AS package, regexp_replace(url, '^https?://([^/.]+)[^/]*/', '\\1/') AS path, page_id % 7 = 0 AS is_test FROM pages), h AS (SELECT package, CASE "
    + " ".join(f"WHEN regexp_matches(path, '{S.glob_regex(g)}') THEN {i}" for i, g in enumerate(_GLOBS))
    + f" END AS place FROM f WHERE NOT is_test) SELECT package, bool_and(place IS NOT NULL) AS gone, [{', '.join(repr(g) for g in _GLOBS)}][min(place) + 1] AS pattern FROM h GROUP BY package HAVING min(place) IS NOT NULL"
)
def r22_excluded_packages(spark, d):
    """Packages that an exclude list touches, whether they are gone, and by which pattern first."""
    rows = table(spark, d, "pages").select((F.col("page_id") % 60).alias("package"), F.regexp_replace("url", "^https?://([^/.]+)[^/]*/", "$1/").alias("path"), (F.col("page_id") % 7 == 0).alias("is_test"))
    return K.excluded_packages(rows, _GLOBS)


_VAR = ["p_brand AS package", "p_partkey AS name", "CASE p_partkey % 5 WHEN 0 THEN 'init' WHEN 1 THEN 'const' ELSE 'var' END AS kind", "p_size % 2 = 0 AS mutable", "p_size % 3 = 0 AS written"]


@query(f"SELECT package, count(*) FILTER (kind = 'var' AND mutable AND written) AS globals, count(*) FILTER (kind = 'init') AS init_funcs FROM (SELECT {', '.join(_VAR)} FROM part) GROUP BY package")
def a11_globals(spark, d):
    """Variables that can change and do, and init functions."""
    return K.global_counts(table(spark, d, "part").selectExpr(*_VAR))


@query("SELECT s_suppkey AS package, coalesce(a.sloc, 0) AS sloc, coalesce(a.files, 0) AS files, coalesce(f.fan_in, 0) AS fan_in, c.churn FROM supplier LEFT JOIN (SELECT l_suppkey, CAST(sum(l_quantity) AS BIGINT) AS sloc, count(DISTINCT l_orderkey) AS files FROM lineitem GROUP BY ALL) a ON a.l_suppkey = s_suppkey LEFT JOIN (SELECT l_partkey AS p, count(DISTINCT l_suppkey) AS fan_in FROM lineitem GROUP BY ALL) f ON f.p = s_suppkey LEFT JOIN (SELECT user_id, count(DISTINCT event_id) AS churn FROM events WHERE event_type = 'click' GROUP BY ALL) c ON c.user_id = s_suppkey")
def a1_assembled(spark, d):
    """A1: one row for each package from aggregates of its facts; what wasn't measured stays unknown."""
    items = table(spark, d, "lineitem")
    size = items.groupBy(F.col("l_suppkey").alias("package")).agg(F.sum("l_quantity").cast("bigint").alias("sloc"), F.count_distinct("l_orderkey").alias("files"))
    fan = items.groupBy(F.col("l_partkey").alias("package")).agg(F.count_distinct("l_suppkey").alias("fan_in"))
    churn = table(spark, d, "events").where("event_type = 'click'").groupBy(F.col("user_id").alias("package")).agg(F.count_distinct("event_id").alias("churn"))
    return K.assemble([size, fan, churn], table(spark, d, "supplier").selectExpr("s_suppkey AS package"), {"sloc": 0, "files": 0, "fan_in": 0})


@query("SELECT l_suppkey AS package, count(*) AS n FROM lineitem GROUP BY ALL")
def r7_snapshot(spark, d):
    """Fact tables written under a snapshot's version and read back."""
    import uuid

    path = f"{shared_path(spark)}/plumbline-facts-{uuid.uuid4().hex}"
    rows = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("package")).agg(F.count("*").alias("n"))
    K.snapshot({"rows": rows.withColumn("n", F.col("n") + 1)}, path, "base")
    K.snapshot({"rows": rows}, path, "head")
    return K.read_snapshot(spark, path, "rows", "head").select("package", "n")


# Renames: a region's package was carved out of two suppliers; the baseline has the suppliers below 7.
_EDGE = "SELECT DISTINCT l_suppkey % 12 AS source, l_partkey % 12 AS target FROM lineitem WHERE l_suppkey % 12 <> l_partkey % 12 AND {cond}"
_HEAD, _BASE = _EDGE.format(cond="l_partkey % 5 < 2"), _EDGE.format(cond="l_partkey % 7 < 2")
_REN = "SELECT r_regionkey + 7 AS package, s AS source, r_regionkey + s AS files FROM region, (VALUES (1), (3), (5)) v(s) WHERE (r_regionkey + s) % 2 = 0"
_ROWS = "SELECT DISTINCT s_suppkey % 7 AS package, s_suppkey % 7 + 2 AS fan_in, s_suppkey % 7 * 2 AS internal_imports, 100 + s_suppkey % 7 AS sloc FROM supplier"
_CARRY = f"""WITH h AS ({_HEAD}), b AS ({_BASE}), rn AS ({_REN}), bs AS ({_ROWS}), nw AS (SELECT * FROM rn WHERE package NOT IN (SELECT package FROM bs)),
ca AS (SELECT DISTINCT nw.source AS importer, nw.package FROM nw JOIN h ON h.source = nw.source AND h.target = nw.package
UNION SELECT DISTINCT b.source, nw.package FROM nw JOIN b ON b.target = nw.source JOIN h h1 ON h1.source = b.source AND h1.target = nw.package JOIN h h2 ON h2.source = b.source AND h2.target = nw.source WHERE b.source <> nw.package AND (b.source, nw.package) NOT IN (SELECT (source, package) FROM nw))
"""


def _renamed(spark, d):
    def edges(n):
        e = table(spark, d, "lineitem").where(f"l_suppkey % 12 <> l_partkey % 12 AND l_partkey % {n} < 2")
        return e.selectExpr("l_suppkey % 12 AS source", "l_partkey % 12 AS target").distinct()

    s = F.explode(F.array(*[F.lit(x) for x in (1, 3, 5)])).alias("source")
    renames = table(spark, d, "region").select((F.col("r_regionkey") + 7).cast("bigint").alias("package"), s, "r_regionkey").withColumn("source", F.col("source").cast("bigint")).withColumn("files", F.col("r_regionkey") + F.col("source")).where("files % 2 = 0").drop("r_regionkey")
    base = table(spark, d, "supplier").selectExpr("s_suppkey % 7 AS package", "s_suppkey % 7 + 2 AS fan_in", "s_suppkey % 7 * 2 AS internal_imports", "100 + s_suppkey % 7 AS sloc").distinct()
    return edges(5), edges(7), renames, base


@query(_CARRY + "SELECT * FROM ca")
def r39_carried_edges(spark, d):
    """Imports of carved-out packages that only follow code to where it moved."""
    head, before, renames, base = _renamed(spark, d)
    return K.carried(renames, base, head, before)


@query(
    _CARRY
    + """SELECT p.package, s.sources, coalesce(bs.fan_in, s.fan_in) AS fan_in, coalesce(bs.internal_imports + coalesce(m.more, 0), s.internal_imports) AS internal_imports, coalesce(bs.sloc, s.sloc) AS sloc FROM (SELECT unnest(range(12)) AS package) p LEFT JOIN bs USING (package)
LEFT JOIN (SELECT importer AS package, count(DISTINCT package) AS more FROM ca GROUP BY importer) m USING (package)
LEFT JOIN (SELECT nw.package, string_agg(DISTINCT CAST(nw.source AS VARCHAR), ',' ORDER BY CAST(nw.source AS VARCHAR)) AS sources, arg_min(x.fan_in, (-files, nw.source)) + count(h.source) AS fan_in, arg_min(x.internal_imports, (-files, nw.source)) AS internal_imports, arg_min(x.sloc, (-files, nw.source)) AS sloc FROM nw JOIN bs x ON x.package = nw.source LEFT JOIN h ON h.source = nw.source AND h.target = nw.package GROUP BY nw.package) s USING (package) WHERE bs.package IS NOT NULL OR s.package IS NOT NULL"""
)
def j14_seeded(spark, d):
    """Baseline rows, own or seeded from the source most files came from, with moved imports counted in."""
    head_edges, before, renames, base = _renamed(spark, d)
    head = spark.range(12).withColumnRenamed("id", "package")
    return K.seeded(head, base, renames, K.carried(renames, base, head_edges, before), head_edges).select("package", "sources", "fan_in", "internal_imports", "sloc")


@query(f"WITH h AS {metrics_sql()}, b AS {metrics_sql(True)}, f AS (SELECT 'pkg' || l_suppkey AS package, count(*) AS n FROM lineitem WHERE l_discount > 0.09 AND l_tax > 0.07 GROUP BY ALL) SELECT h.package, b.package IS NULL AS new, CASE WHEN h.sloc % 10 = 0 THEN 'unavailable' ELSE 'parent' END AS baseline, h.sloc - coalesce(b.sloc, 0) AS sloc_delta, coalesce(f.n, 0) AS violations, coalesce(f.n, 0) = 0 AS passed FROM h LEFT JOIN b USING (package) LEFT JOIN f USING (package)")
def r14_fact_rows(spark, d):
    """What a replay records of every checked package."""
    head = package_metrics(spark, d)
    found = table(spark, d, "lineitem").where("l_discount > 0.09 AND l_tax > 0.07").selectExpr("'pkg' || l_suppkey AS package", "'violation' AS kind", "CAST(NULL AS STRING) AS reason")
    return K.fact_rows(head, package_metrics(spark, d, base=True), found, head.where("sloc % 10 = 0"))


_IMP = ["l_suppkey AS source", "l_partkey % 30 AS specifier_package", "'n' || (l_orderkey % 20) AS name"]
_EXP = ["p_partkey % 30 AS package", "'n' || (p_size % 20) AS name", "CASE WHEN p_size % 3 = 0 THEN 500 + p_partkey % 30 END AS origin"]


@query(f"WITH i AS (SELECT {', '.join(_IMP)} FROM lineitem), e AS (SELECT DISTINCT {', '.join(_EXP)} FROM part), o AS (SELECT * FROM e WHERE origin IS NOT NULL) SELECT DISTINCT source, coalesce(origin, specifier_package) AS target, i.name FROM i LEFT JOIN o ON o.package = specifier_package AND o.name = i.name WHERE source <> coalesce(origin, specifier_package)")
def r20_linked(spark, d):
    """Imports that go through a re-export link to where the name comes from."""
    return K.linked(table(spark, d, "lineitem").selectExpr(*_IMP), table(spark, d, "part").selectExpr(*_EXP))


@query("SELECT s_suppkey, CASE WHEN s_nationkey = 3 THEN 'main' WHEN f > 0 AND a = 0 THEN 'generated-only' WHEN s_acctbal < 0 THEN 'test-support' ELSE 'library' END AS role FROM supplier JOIN (SELECT l_suppkey, count(*) FILTER (l_partkey % 100 < s) AS f, count(*) FILTER (l_partkey % 100 < s AND l_partkey % 2 = 0) AS a FROM (SELECT *, l_suppkey % 3 AS s FROM lineitem) GROUP BY ALL) ON l_suppkey = s_suppkey")
def x15_roles(spark, d):
    """The role of a package, the first rule that holds."""
    items = table(spark, d, "lineitem").withColumn("s", F.col("l_suppkey") % 3)
    few = F.col("l_partkey") % 100 < F.col("s")
    files = items.groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count_if(few).alias("f"), F.count_if(few & (F.col("l_partkey") % 2 == 0)).alias("a"))
    met = table(spark, d, "supplier").join(files, "s_suppkey")
    return met.select("s_suppkey", K.role(F.col("s_nationkey") == 3, F.col("f"), F.col("a"), F.col("s_acctbal") < 0).alias("role"))


@query("SELECT url, CASE WHEN path = host THEN '.' WHEN starts_with(path, host || '/') THEN substr(path, length(host) + 2) ELSE path END AS rel, host || '/' || page_id AS path, starts_with(path, host || '/fr/') AS below, NOT contains(split_part(path, '/', 1), '.') AS std FROM (SELECT page_id, url, regexp_replace(url, '^https?://', '') AS path, split_part(regexp_replace(url, '^https?://', ''), '/', 1) AS host FROM pages)")
def x9_module_paths(spark, d):
    """Paths relative to a module and back, own descendants, standard library paths."""
    path = F.regexp_replace("url", "^https?://", "")
    host = F.split_part(path, F.lit("/"), F.lit(1))
    return table(spark, d, "pages").select(
        "url", S.module_relative(path, host).alias("rel"), S.import_path(host, F.col("page_id").cast("string")).alias("path"),
        S.is_below(path, F.concat(host, F.lit("/fr"))).alias("below"), S.is_stdlib(path).alias("std"),
    )
