"""Matching, graph, duplication-set and aggregation operators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import scalar as S
from plumbline.operators import aggregates as A
from plumbline.operators import matching as M
from plumbline.sources.host import table

CUT = "TIMESTAMP '1999-01-01 00:00:00'"
QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# Functions: a supplier's line items; a name is a part modulo 40, a fingerprint the return flag.
_FUNCS = "l_suppkey AS package, l_partkey % 40 AS name, l_returnflag AS fingerprint, l_orderkey * 10 + l_linenumber AS ord, CAST(l_quantity AS BIGINT) AS value"


def _functions(spark, d, base):
    rows = table(spark, d, "lineitem").where(f"l_shipdate < {CUT}" if base else f"l_shipdate >= {CUT}")
    return rows.selectExpr(*[x.strip() for x in _FUNCS.split(", ")])


def _funcs_sql(base):
    return f"(SELECT {_FUNCS} FROM lineitem WHERE l_shipdate {'<' if base else '>='} {CUT})"


_J2 = f"""WITH h AS (SELECT *, row_number() OVER (PARTITION BY package, name, fingerprint ORDER BY ord) AS k FROM {_funcs_sql(False)}),
b AS (SELECT *, row_number() OVER (PARTITION BY package, name, fingerprint ORDER BY ord) AS k FROM {_funcs_sql(True)}),
c AS (SELECT package, name, fingerprint, ord, value, row_number() OVER (PARTITION BY package, name ORDER BY ord) AS k2 FROM h ANTI JOIN b USING (package, name, fingerprint, k)),
l AS (SELECT package, name, value, row_number() OVER (PARTITION BY package, name ORDER BY ord) AS k2 FROM b ANTI JOIN h USING (package, name, fingerprint, k))
"""


@query(_J2 + "SELECT c.package, c.name, c.fingerprint, c.ord, c.value, l.value AS base_value FROM c LEFT JOIN l USING (package, name, k2)")
def j2_changed_functions(spark, d):
    return M.changed_functions(_functions(spark, d, False), _functions(spark, d, True), ["package", "name"])


@query(_J2 + "SELECT package, name, ord, value, base_value FROM (SELECT *, row_number() OVER (PARTITION BY package ORDER BY value DESC, ord) AS rn FROM (SELECT c.*, l.value AS base_value FROM c LEFT JOIN l USING (package, name, k2)) WHERE value > 40 AND (base_value IS NULL OR base_value < 40 OR value - base_value > 5)) WHERE rn = 1")
def g8_worst_changed(spark, d):
    from plumbline.operators.gate import worst_changed

    changed = j2_changed_functions(spark, d).withColumnRenamed("value", "cognitive").withColumnRenamed("base_value", "base_cognitive")
    return worst_changed(changed, 40, 5).selectExpr("package", "name", "ord", "cognitive AS value", "base_cognitive AS base_value")


@query("SELECT package, ord, key, k > coalesce(had, 0) AS is_new FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ord) AS k FROM (SELECT l_suppkey AS package, l_orderkey * 10 + l_linenumber AS ord, CAST(l_partkey % 300 AS VARCHAR) || l_returnflag AS key FROM lineitem WHERE l_shipdate >= TIMESTAMP '1999-01-01 00:00:00')) h LEFT JOIN (SELECT CAST(l_partkey % 300 AS VARCHAR) || l_returnflag AS key, count(*) AS had FROM lineitem WHERE l_shipdate < TIMESTAMP '1999-01-01 00:00:00' GROUP BY ALL) b USING (key)")
def j7_new_blocks(spark, d):
    rows = table(spark, d, "lineitem").selectExpr("l_suppkey AS package", "l_orderkey * 10 + l_linenumber AS ord", "concat(CAST(l_partkey % 300 AS STRING), l_returnflag) AS key", "l_shipdate")
    return M.excess(rows.where(f"l_shipdate >= {CUT}").drop("l_shipdate"), rows.where(f"l_shipdate < {CUT}"), "key")


@query(f"WITH b AS (SELECT l_orderkey FROM lineitem WHERE l_shipdate < {CUT}) SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_shipdate >= {CUT} AND l_orderkey NOT IN (SELECT l_orderkey FROM b) AND l_orderkey + 1 NOT IN (SELECT l_orderkey FROM b)")
def j5_new_by_anchors(spark, d):
    rows = table(spark, d, "lineitem")
    head = rows.where(f"l_shipdate >= {CUT}").selectExpr("l_orderkey", "l_linenumber", "l_partkey", "l_orderkey AS a0", "l_orderkey + 1 AS a1")
    return M.without_either(head, rows.where(f"l_shipdate < {CUT}").selectExpr("l_orderkey AS anchor"), "a0", "a1").select("l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT DISTINCT l_suppkey AS package, l_partkey AS name FROM lineitem WHERE l_shipdate >= TIMESTAMP '1999-01-01 00:00:00' EXCEPT SELECT l_suppkey, l_partkey FROM lineitem WHERE l_shipdate < TIMESTAMP '1999-01-01 00:00:00'")
def j6_newly_untested(spark, d):
    rows = table(spark, d, "lineitem")
    pick = ["l_suppkey AS package", "l_partkey AS name"]
    return rows.where(f"l_shipdate >= {CUT}").selectExpr(*pick).distinct().join(rows.where(f"l_shipdate < {CUT}").selectExpr(*pick), ["package", "name"], "left_anti")


_SIG = "SELECT DISTINCT l_suppkey AS package, l_partkey AS name, l_returnflag AS sig FROM lineitem WHERE l_shipdate"


@query(f"WITH h AS ({_SIG} >= {CUT}), b AS ({_SIG} < {CUT}) SELECT h.* FROM h WHERE (package, name) IN (SELECT package, name FROM b) AND (package, name, sig) NOT IN (SELECT package, name, sig FROM b)")
def j3_signature_changes(spark, d):
    rows = table(spark, d, "lineitem").selectExpr("l_suppkey AS package", "l_partkey AS name", "l_returnflag AS sig", "l_shipdate")
    return M.signature_changes(rows.where(f"l_shipdate >= {CUT}").drop("l_shipdate").distinct(), rows.where(f"l_shipdate < {CUT}").drop("l_shipdate").distinct())


# The import graph: a supplier imports the part's package; returns are test edges.
_EDGES = "SELECT DISTINCT l_suppkey AS source, l_partkey AS target, l_returnflag = 'R' AS test FROM lineitem"


def _edges(spark, d):
    return table(spark, d, "lineitem").selectExpr("l_suppkey AS source", "l_partkey AS target", "l_returnflag = 'R' AS test").distinct()


@query(f"WITH e AS ({_EDGES}), p AS (SELECT DISTINCT source, target FROM e WHERE NOT test), t AS (SELECT DISTINCT source, target FROM e WHERE test AND source <> target EXCEPT SELECT * FROM p) SELECT target AS package, CAST(sum(p) AS BIGINT) AS fan_in, CAST(sum(t) AS BIGINT) AS fan_in_tests FROM (SELECT target, 1 AS p, 0 AS t FROM p UNION ALL SELECT target, 0, 1 FROM t) GROUP BY target")
def j11_fan_in(spark, d):
    return M.fan_in(_edges(spark, d))


@query("SELECT url, CASE WHEN path = m OR starts_with(path, m || '/') THEN 'internal' WHEN contains(split_part(path, '/', 1), '.') THEN 'external' ELSE 'stdlib' END AS class FROM (SELECT url, regexp_replace(url, '^https?://', '') AS path, 'example.com' AS m FROM pages)")
def j12_import_class(spark, d):
    rows = table(spark, d, "pages").select("url", F.regexp_replace("url", "^https?://", "").alias("path"))
    return rows.select("url", M.import_class(F.col("path"), F.lit("example.com")).alias("class"))


@query(f"WITH e AS ({_EDGES}), c AS (SELECT s_suppkey AS package FROM supplier WHERE s_acctbal < 0) SELECT DISTINCT source AS package FROM e WHERE target IN (SELECT package FROM c) AND source NOT IN (SELECT package FROM c)")
def j13_importers(spark, d):
    return M.importers(_edges(spark, d), table(spark, d, "supplier").where("s_acctbal < 0").selectExpr("s_suppkey AS package"))


_OWN = "SELECT l_suppkey AS package, count(*) AS rows, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS sloc FROM lineitem WHERE l_suppkey % 3 <> 0 GROUP BY l_suppkey"


@query(f"WITH b AS ({_OWN}), rn AS (SELECT l_suppkey AS package, l_partkey % 100 AS source, count(*) AS files FROM lineitem GROUP BY ALL), s AS (SELECT package, source, rows, sloc FROM (SELECT r.package, r.source, b.rows, b.sloc, row_number() OVER (PARTITION BY r.package ORDER BY files DESC, r.source) AS k FROM rn r JOIN b ON b.package = r.source) WHERE k = 1) SELECT s_suppkey AS package, CASE WHEN b.package IS NULL THEN s.source END AS source, CASE WHEN b.package IS NULL THEN s.rows ELSE b.rows END AS rows, CASE WHEN b.package IS NULL THEN s.sloc ELSE b.sloc END AS sloc FROM supplier LEFT JOIN b ON b.package = s_suppkey LEFT JOIN s ON s.package = s_suppkey WHERE b.package IS NOT NULL OR s.package IS NOT NULL")
def j14_seeded_rows(spark, d):
    rows = table(spark, d, "lineitem")
    base = rows.where("l_suppkey % 3 <> 0").groupBy(F.col("l_suppkey").alias("package")).agg(F.count("*").alias("rows"), F.sum(F.col("l_quantity").cast("bigint")).alias("sloc"))
    renames = rows.selectExpr("l_suppkey AS package", "l_partkey % 100 AS source")
    ranked = M.rank_sources(renames)
    return M.seeded_rows(table(spark, d, "supplier").selectExpr("s_suppkey AS package"), base, ranked, ["rows", "sloc"])


@query("SELECT package, source, files, row_number() OVER (PARTITION BY package ORDER BY files DESC, source) AS place FROM (SELECT l_suppkey AS package, l_partkey % 100 AS source, count(*) AS files FROM lineitem GROUP BY ALL)")
def r1_rename_sources(spark, d):
    return M.rank_sources(table(spark, d, "lineitem").selectExpr("l_suppkey AS package", "l_partkey % 100 AS source"))


@query("WITH i AS (SELECT l_suppkey AS k, l_orderkey % 5000 AS lo, l_orderkey % 5000 + l_linenumber AS hi FROM lineitem), o AS (SELECT l_suppkey AS k, l_orderkey % 5000 AS f, l_orderkey % 5000 + 20 AS t FROM lineitem) SELECT i.k, lo, hi, count(*) AS covers FROM i JOIN o ON i.k = o.k AND lo >= f AND hi <= t GROUP BY ALL")
def j16_contained(spark, d):
    rows = table(spark, d, "lineitem")
    i = rows.selectExpr("l_suppkey AS k", "l_orderkey % 5000 AS lo", "l_orderkey % 5000 + l_linenumber AS hi")
    o = rows.selectExpr("l_suppkey AS k", "l_orderkey % 5000 AS from", "l_orderkey % 5000 + 20 AS to")
    return M.contained(i, o, ["k"], 64).groupBy("k", "lo", "hi").agg(F.count("*").alias("covers"))


@query("WITH r AS (SELECT user_id, event_id AS seq FROM events WHERE event_type = 'error'), l AS (SELECT user_id, event_id AS seq FROM events WHERE event_type = 'purchase') SELECT r.user_id, r.seq, min(l.seq) AS next FROM r LEFT JOIN l ON l.user_id = r.user_id AND l.seq > r.seq AND l.seq <= r.seq + 400 GROUP BY ALL")
def j20_first_within(spark, d):
    e = table(spark, d, "events").selectExpr("user_id", "event_id AS seq", "event_type")
    return M.first_within(e.where("event_type = 'error'").drop("event_type"), e.where("event_type = 'purchase'").drop("event_type"), ["user_id"], 400)


@query("SELECT r.user_id, r.event_id AS seq, arg_max(f.value, f.event_id) AS value FROM events r LEFT JOIN events f ON f.user_id = r.user_id AND f.event_type = 'signup' AND f.event_id < r.event_id WHERE r.event_type = 'error' GROUP BY ALL")
def j21_as_of(spark, d):
    e = table(spark, d, "events").selectExpr("user_id", "event_id AS seq", "event_type", "value")
    return M.as_of(e.where("event_type = 'error'").select("user_id", "seq"), e.where("event_type = 'signup'").select("user_id", "seq", "value"), ["user_id"], "value").select("user_id", "seq", "value")


@query(f"SELECT l_orderkey AS package, CASE WHEN bool_or(l_shipdate >= {CUT}) THEN 'changed' ELSE 'deleted' END AS state FROM lineitem GROUP BY l_orderkey")
def j27_changed_packages(spark, d):
    rows = table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "package")
    return M.changed_packages(rows, rows.where(f"l_shipdate >= {CUT}"), rows.where(f"l_shipdate < {CUT}"))


# Orders that follow one another are linked by a line whose part is a multiple of nine: runs are the components.
@query("WITH o AS (SELECT o_orderkey AS id, coalesce(bool_or(l_partkey % 9 = 0), false) AS tied FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey), s AS (SELECT id, CASE WHEN lag(tied) OVER (ORDER BY id) AND lag(id) OVER (ORDER BY id) = id - 1 THEN 0 ELSE 1 END AS begins FROM o) SELECT id, max(CASE WHEN begins = 1 THEN id END) OVER (ORDER BY id) AS component FROM s")
def j9_components(spark, d):
    """Connected components over all edges."""
    from plumbline.sources.shared import ensure_shared

    ensure_shared(spark)
    v = table(spark, d, "orders").selectExpr("o_orderkey AS id")
    e = table(spark, d, "lineitem").selectExpr("l_orderkey AS a", "CASE WHEN l_partkey % 9 = 0 THEN l_orderkey + 1 ELSE l_orderkey END AS b").distinct()
    e = e.join(v.withColumnRenamed("id", "b"), "b", "left_semi")
    return M.min_labels(v, e)


@query("SELECT o_orderkey, coalesce(string_agg(DISTINCT CAST(l_suppkey AS VARCHAR), ',' ORDER BY CAST(l_suppkey AS VARCHAR)), '') AS items FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def u3_set_keys(spark, d):
    keys = M.grouped_sets(table(spark, d, "lineitem").withColumn("s", F.col("l_suppkey").cast("string")), "l_orderkey", "s")
    return table(spark, d, "orders").join(keys, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", F.replace("set_key", F.lit("\u0000"), F.lit(",")).alias("items"))


@query("SELECT conv_id, string_agg(DISTINCT role, ',' ORDER BY role) AS roles FROM conversations GROUP BY conv_id")
def u2_distinct_sorted(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(F.array_sort(F.collect_set("role")), ",").alias("roles"))


@query("SELECT c.c_nationkey AS a, len(list_intersect(list(DISTINCT c.c_mktsegment), ['MACHINERY', 'HOUSEHOLD'])) AS shared, len(list_distinct(list_concat(list(DISTINCT c.c_mktsegment), ['MACHINERY', 'OTHER']))) AS united FROM customer c GROUP BY c.c_nationkey")
def u4_u5_set_algebra(spark, d):
    g = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("a")).agg(F.collect_set("c_mktsegment").alias("s"))
    lit = lambda *x: F.array(*map(F.lit, x))
    return g.select("a", F.size(F.array_intersect("s", lit("MACHINERY", "HOUSEHOLD"))).cast("bigint").alias("shared"), F.size(F.array_union("s", lit("MACHINERY", "OTHER"))).cast("bigint").alias("united"))


@query("SELECT source AS package, count(*) AS files, CAST(sum(n_chars) AS BIGINT) AS sloc, arg_min(doc_id, (-n_chars, doc_id)) AS largest_file, max(n_chars) AS largest_file_sloc, CAST(floor(CAST(sum(n_chars) AS BIGINT) / 3.2) AS BIGINT) AS tokens_est FROM documents GROUP BY source")
def a2_size(spark, d):
    rows = table(spark, d, "documents").selectExpr("source AS package", "doc_id AS file", "n_chars AS sloc", "n_chars AS bytes")
    return A.size(rows)


@query("SELECT l_suppkey AS package, count(*) AS func_count, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS total, max(l_linenumber) AS max_nesting, CAST(quantile_disc(CAST(l_quantity AS BIGINT), 0.9) AS BIGINT) AS p90 FROM lineitem GROUP BY l_suppkey")
def a6_a7_complexity(spark, d):
    return A.complexity(table(spark, d, "lineitem").selectExpr("l_suppkey AS package", "CAST(l_quantity AS BIGINT) AS value", "l_linenumber AS nesting"))


@query(f"WITH e AS ({_EDGES}) SELECT source AS package, count(DISTINCT target) FILTER (NOT test) AS imports, count(DISTINCT target) FILTER (NOT test AND target // 10 = source // 10) AS descendants, count(DISTINCT target) FILTER (NOT test AND target % 7 = 0) AS private FROM e GROUP BY source")
def a8_imports(spark, d):
    e = _edges(spark, d)
    plain = F.col("target")
    pick = lambda c: F.count_distinct(F.when(~F.col("test") & c, plain))
    return e.groupBy(F.col("source").alias("package")).agg(pick(F.lit(True)).alias("imports"), pick(F.expr("target div 10 = source div 10")).alias("descendants"), pick(F.col("target") % 7 == 0).alias("private"))


@query("SELECT p_brand AS package, count(*) FILTER (p_size > 20) AS exported, count(*) FILTER (p_size > 20 AND p_type = 'ECONOMY') AS types, count(*) FILTER (p_size > 20 AND p_name LIKE 'red%') AS documented, bool_or(p_type = 'PROMO') AS uses_reflect, count(*) FILTER (p_name LIKE '%widget') AS test_files FROM part GROUP BY p_brand")
def a10_symbols(spark, d):
    """Conditional counts and flags over symbols."""
    r = table(spark, d, "part").groupBy(F.col("p_brand").alias("package"))
    out = F.col("p_size") > 20
    return r.agg(F.count_if(out).alias("exported"), F.count_if(out & (F.col("p_type") == "ECONOMY")).alias("types"), F.count_if(out & F.col("p_name").startswith("red")).alias("documented"), F.bool_or(F.col("p_type") == "PROMO").alias("uses_reflect"), F.count_if(F.col("p_name").endswith("widget")).alias("test_files"))


@query("SELECT event_type AS package, count(DISTINCT event_id) AS commits, count(DISTINCT user_id) AS authors FROM (SELECT * FROM events ORDER BY event_id DESC LIMIT 2000) GROUP BY event_type")
def a16_churn(spark, d):
    """W5 before A16: only the last 2000 commits are attributed."""
    e = table(spark, d, "events").select(F.col("event_id").alias("seq"), F.col("event_type").alias("package"), F.concat(F.lit(" User"), F.col("user_id").cast("string"), F.when(F.col("event_id") % 2 == 0, " ").otherwise("")).alias("author"))
    return A.churn(e, 2000)


@query("SELECT l_suppkey AS file, CAST(sum(s) AS BIGINT) AS stmts, CAST(sum(s) FILTER (c > 0) AS BIGINT) AS ran, round(sum(s) FILTER (c > 0) * 1000.0 / sum(s)) / 10 AS pct FROM (SELECT l_suppkey, l_partkey, CAST(max(l_linenumber) AS BIGINT) AS s, CAST(sum(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) AS BIGINT) AS c FROM lineitem GROUP BY ALL) GROUP BY l_suppkey")
def a17_coverage(spark, d):
    blocks = table(spark, d, "lineitem").selectExpr("l_suppkey AS file", "l_partkey AS span", "CAST(l_linenumber AS BIGINT) AS stmts", "CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END AS count")
    return A.coverage(blocks)


@query("SELECT o_orderpriority AS k, count(*) FILTER (v <= 10) AS easy, count(*) FILTER (v > 10 AND v <= 20) AS care, count(*) FILTER (v > 20) AS hard FROM (SELECT o_orderpriority, o_custkey % 30 AS v FROM orders) GROUP BY ALL")
def a20_buckets(spark, d):
    return A.buckets(table(spark, d, "orders").selectExpr("o_orderpriority AS k", "o_custkey % 30 AS v"), "k", "v")


@query("SELECT l_suppkey AS a, CASE WHEN n = 0 THEN 0.0 ELSE CAST(k AS DOUBLE) / n END AS share FROM (SELECT l_suppkey, count(*) FILTER (l_quantity > 49) AS n, count(*) FILTER (l_quantity > 49 AND l_tax > 0.04) AS k FROM lineitem GROUP BY ALL)")
def a19_share(spark, d):
    r = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("a")).agg(F.count_if(F.col("l_quantity") > 49).alias("n"), F.count_if((F.col("l_quantity") > 49) & (F.col("l_tax") > 0.04)).alias("k"))
    return r.select("a", S.share("k", "n").alias("share"))


@query("SELECT url, CASE WHEN regexp_matches(path, '^[^/]*/docs(?:/.*)?$') THEN '*/docs' WHEN regexp_matches(path, '^(?:[^/]+/)*p[^/]*1(?:/.*)?$') THEN '**/p*1' END AS pattern FROM (SELECT url, regexp_replace(url, '^https?://', '') AS path FROM pages)")
def p12_exclude(spark, d):
    rows = table(spark, d, "pages").select("url", F.regexp_replace("url", "^https?://", "").alias("path"))
    return rows.select("url", S.first_match(F.col("path"), ["*/docs", "**/p*1"]).alias("pattern"))


@query("WITH x AS (SELECT DISTINCT l_orderkey AS block, l_suppkey AS pkg, l_suppkey % 2 AS role FROM lineitem) SELECT block, count(*) AS packages, bool_and(role = 1) AS main_only FROM x GROUP BY block HAVING count(DISTINCT pkg) >= 2")
def a15_cross_blocks(spark, d):
    """Blocks in two packages or more, and whether only mains hold them."""
    x = table(spark, d, "lineitem").selectExpr("l_orderkey AS block", "l_suppkey AS pkg", "l_suppkey % 2 AS role").distinct()
    return x.groupBy("block").agg(F.count("*").alias("packages"), F.bool_and(F.col("role") == 1).alias("main_only"), F.count_distinct("pkg").alias("n")).where("n >= 2").drop("n")


@query("WITH c AS (SELECT DISTINCT o_orderkey AS c, o_orderpriority AS rule FROM orders WHERE o_orderstatus = 'F' UNION SELECT o_orderkey, 'big' FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 300000), n AS (SELECT c, count(*) AS k FROM c GROUP BY c) SELECT rule, count(*) AS failed, count(*) FILTER (k = 1) AS alone FROM c JOIN n USING (c) GROUP BY rule")
def a18_rule_summary(spark, d):
    """Commits each rule failed, and failed alone."""
    o = table(spark, d, "orders").where("o_orderstatus = 'F'")
    c = o.selectExpr("o_orderkey AS c", "o_orderpriority AS rule").union(o.where("o_totalprice > 300000").selectExpr("o_orderkey", "'big'"))
    return A.rule_summary(c)
