"""Exported surface, tests and the places of findings, over line items and parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import surface as X
from plumbline.plans.rules import SHIPPED
from plumbline.queries.registry import registry
from plumbline.sources.host import table

QUERIES, SQL, query = registry()
CUT = "TIMESTAMP '1999-01-01 00:00:00'"
SURFACE = next(r for r in SHIPPED if r.metric == "exported_symbols")

# Symbols: a supplier's line items; every fifth line is unexported at head, all else exported.
_SYM = ["l_suppkey AS package", "'func' AS kind", "CASE WHEN l_linenumber % 2 = 0 THEN 'T' ELSE '' END AS receiver", "'Fn' || (l_partkey % 35) AS name", "CAST(l_quantity AS BIGINT) % 4 AS signature", "l_orderkey * 10 + l_linenumber AS ord"]
_SYMS = ", ".join(_SYM)
_FACTS = f"""WITH h AS (SELECT {_SYMS} FROM lineitem WHERE l_shipdate >= {CUT} AND l_partkey % 5 <> 0),
x AS (SELECT * REPLACE (lower(substr(name, 1, 1)) || substr(name, 2) AS name) FROM (SELECT {_SYMS} FROM lineitem WHERE l_shipdate >= {CUT} AND l_partkey % 5 = 0)),
b AS (SELECT {_SYMS} FROM lineitem WHERE l_shipdate < {CUT}),
sc AS (SELECT DISTINCT package, receiver, name, signature FROM h WHERE (package, receiver, name) IN (SELECT (package, receiver, name) FROM b) AND (package, receiver, name, signature) NOT IN (SELECT (package, receiver, name, signature) FROM b)),
lo AS (SELECT package, kind, receiver, lower(name) AS low, arg_min(name, ord) AS now FROM x GROUP BY ALL),
ue AS (SELECT DISTINCT package, receiver, name, now FROM b JOIN lo USING (package, kind, receiver) WHERE lower(name) = low AND (package, receiver, name) NOT IN (SELECT (package, receiver, name) FROM h)),
q AS (SELECT package, 0 AS part, CASE WHEN receiver = '' THEN name ELSE receiver || '.' || name END AS q, ' (signature changed)' AS t FROM sc UNION ALL SELECT package, 1, CASE WHEN receiver = '' THEN name ELSE receiver || '.' || name END, ' (unexported as ' || now || ')' FROM ue),
"""


def _symbols(spark, d):
    rows = table(spark, d, "lineitem")
    head, base = rows.where(f"l_shipdate >= {CUT}"), rows.where(f"l_shipdate < {CUT}").selectExpr(*_SYM)
    low = F.concat(F.lower(F.substring("name", 1, 1)), F.substring("name", 2, 100))
    return head.where("l_partkey % 5 <> 0").selectExpr(*_SYM), head.where("l_partkey % 5 = 0").selectExpr(*_SYM).withColumn("name", low), base


def _reshaped(spark, d):
    head, hidden, base = _symbols(spark, d)
    return X.reshaped(X.signature_changes(head, base), X.made_unexported(head, hidden, base))


@query(_FACTS + "z AS (SELECT 1) SELECT package, receiver, name, now FROM ue")
def j4_made_private(spark, d):
    """Base exports that head has under the same name in lower case only."""
    return X.made_unexported(*_symbols(spark, d)).select("package", "receiver", "name", "now")


@query(
    _FACTS
    + f"""n AS (SELECT package, count(*) AS n, list(q || t ORDER BY part, q) AS l FROM q GROUP BY package),
c AS (SELECT package, count(DISTINCT receiver || '.' || name) AS head FROM h GROUP BY package), cb AS (SELECT package, count(*) AS base FROM b GROUP BY package)
SELECT package, head, n, CASE WHEN n > 5 THEN array_to_string(l[1:5], ', ') || ' and ' || (n - 5) || ' more' WHEN n = 1 THEN l[1] ELSE array_to_string(l[1:n - 1], ', ') || ' and ' || l[n] END AS text
FROM n JOIN c USING (package) JOIN cb USING (package) WHERE head >= {SURFACE.warn_at} * {SURFACE.max} - 1e-9"""
)
def g13_reshaped(spark, d):
    """What changed in the exports of packages near their ceiling, without adding one."""
    head, _, base = _symbols(spark, d)
    counts = head.groupBy("package").agg(F.count_distinct(F.concat_ws(".", "receiver", "name")).alias("head"))
    had = base.groupBy("package").agg(F.count("*").alias("base"))
    rows = _reshaped(spark, d).join(counts, "package").join(had, "package", "left")
    near = rows.where(X.in_warn_band(F.col("head"), F.col("base"), SURFACE.max, SURFACE.warn_at))
    return near.select("package", "head", F.size("names").cast("bigint").alias("n"), X.listed(F.col("names")).alias("text"))


# Untested exports: a brand's parts; a customer's key is the part that a test refers to.
_EXPORTS = ["p_brand AS package", "p_partkey AS key", "CASE WHEN p_size % 3 = 0 THEN '' ELSE 'R' || (p_size % 6) END AS receiver", "'M' || (p_partkey % 60) AS name", "p_size % 10 = 0 AS generated", "p_size % 13 = 0 AS excluded", "p_name LIKE 'red%' AS option", "p_size % 6 > 3 AS receiver_exported"]
_REFS = ["c_custkey AS key", "CASE c_mktsegment WHEN 'BUILDING' THEN 'own' WHEN 'MACHINERY' THEN 'support' ELSE 'other' END AS origin"]
_HELD = ["'M' || (s_suppkey % 90) AS name", "s_nationkey AS interface", "'Brand#' || (s_suppkey % 25 + 1) AS under", "s_suppkey % 3 = 0 AS support", "s_suppkey % 2 = 0 AS call"]
_IMPL = ["package", "'R' || (n_nationkey % 6) AS receiver", "n_nationkey AS interface"]


@query(
    f"""WITH e AS (SELECT * FROM (SELECT {', '.join(_EXPORTS)} FROM part) WHERE NOT generated AND NOT excluded),
r AS (SELECT key, bool_and(origin = 'support') AS only FROM (SELECT {', '.join(_REFS)} FROM customer) GROUP BY key),
x AS (SELECT DISTINCT {', '.join(_HELD)} FROM supplier),
m AS (SELECT e.package, e.key, call, bool_and(x.support) AS sup FROM e JOIN x USING (name) JOIN nation n ON e.receiver = 'R' || (n.n_nationkey % 6) AND n.n_nationkey = x.interface WHERE e.receiver <> '' GROUP BY ALL)
SELECT e.package, e.key, CASE WHEN r.key IS NOT NULL THEN 'tested' WHEN receiver <> '' AND e.key % 11 = 0 THEN 'std' WHEN dm.key IS NOT NULL THEN 'dispatched' WHEN option THEN 'option' WHEN receiver <> '' AND NOT receiver_exported AND hm.key IS NOT NULL THEN 'held' ELSE 'untested' END AS state,
coalesce(CASE WHEN r.key IS NOT NULL THEN r.only WHEN receiver <> '' AND e.key % 11 = 0 THEN false WHEN dm.key IS NOT NULL THEN dm.sup ELSE false END, false) AS by_support
FROM e LEFT JOIN r USING (key) LEFT JOIN m dm ON dm.key = e.key AND dm.call LEFT JOIN m hm ON hm.key = e.key AND NOT hm.call"""
)
def j15_untested_exports(spark, d):
    """Exports by what first makes them tested, or leaves them out."""
    parts = table(spark, d, "part")
    exports = parts.selectExpr(*_EXPORTS)
    refs = table(spark, d, "customer").selectExpr(*_REFS).join(parts.selectExpr("p_partkey AS key", "p_brand AS package"), "key")
    std = parts.where("p_partkey % 11 = 0").selectExpr("p_brand AS package", "p_partkey AS key")
    index = table(spark, d, "supplier").selectExpr(*_HELD)
    types = parts.selectExpr("p_brand AS package").distinct().join(F.broadcast(table(spark, d, "nation")), F.lit(True))  # 25 interfaces
    return X.untested_exports(exports, refs, std, index.where("call"), index.where("not call"), types.selectExpr(*_IMPL))


@query("WITH t AS (SELECT DISTINCT 'M' || (s_suppkey % 90) AS name FROM supplier WHERE s_suppkey % 4 <> 0) SELECT DISTINCT p_brand AS package, 'M' || (p_partkey % 120) AS name FROM part WHERE 'M' || (p_partkey % 120) NOT IN (SELECT name FROM t)")
def r36_untested_by_name(spark, d):
    """Exports whose name no test file of the module has."""
    names = table(spark, d, "supplier").where("s_suppkey % 4 <> 0").selectExpr("'M' || (s_suppkey % 90) AS name")
    return X.untested_by_name(table(spark, d, "part").selectExpr("p_brand AS package", "'M' || (p_partkey % 120) AS name"), names)


_T = "SELECT l_suppkey AS under, l_orderkey AS package, l_returnflag = 'R' AS test, l_orderkey AS key FROM lineitem"


@query(f"WITH e AS ({_T}) SELECT DISTINCT package FROM e WHERE test AND under <> package AND package NOT IN (SELECT package FROM e WHERE NOT test)")
def r37_support_packages(spark, d):
    """Packages that other packages' tests refer to and nothing else in the module imports."""
    e = table(spark, d, "lineitem").selectExpr("l_suppkey AS under", "l_orderkey AS package", "l_returnflag = 'R' AS test")
    return X.support_packages(e.where("not test").selectExpr("under AS source", "package AS target"), e.where("test"))


@query("WITH e AS (SELECT l_suppkey AS under, l_partkey % 150 AS package FROM lineitem), s AS (SELECT n_nationkey * 4 AS under FROM nation) SELECT CASE WHEN under = package THEN 'own' WHEN under IN (SELECT under FROM s) THEN 'support' ELSE 'other' END AS origin, count(*) AS n FROM e GROUP BY ALL")
def r37_reference_origins(spark, d):
    """What a support package's own tests refer to counts as support."""
    e = table(spark, d, "lineitem").selectExpr("l_suppkey AS under", "l_partkey % 150 AS package")
    return X.reference_origins(e, table(spark, d, "nation").selectExpr("n_nationkey * 4 AS package")).groupBy("origin").agg(F.count("*").alias("n"))


@query("SELECT s_suppkey AS package, CASE WHEN s_suppkey % 4 <> 0 AND s_suppkey % 3 <> 0 AND s_suppkey % 5 <> 0 THEN coalesce(n, 0) WHEN s_suppkey % 3 = 0 THEN 1 END AS base_covered FROM supplier LEFT JOIN (SELECT package, count(*) AS n FROM (SELECT DISTINCT l_suppkey AS package, l_partkey % 200 AS name FROM lineitem WHERE l_returnflag = 'A' EXCEPT SELECT l_suppkey, l_partkey % 200 FROM lineitem WHERE l_returnflag = 'R') GROUP BY package) ON package = s_suppkey")
def g15_covered_base(spark, d):
    """The baseline's covered figure, or what head's run leaves of the baseline's names."""
    rows = table(spark, d, "supplier").selectExpr("s_suppkey AS package", "CASE WHEN s_suppkey % 4 <> 0 THEN 1L END AS head_covered", "CASE WHEN s_suppkey % 3 = 0 THEN 1L END AS base_covered", "s_suppkey % 5 <> 0 AS has_named")
    names = lambda flag: table(spark, d, "lineitem").where(F.col("l_returnflag") == flag).selectExpr("l_suppkey AS package", "l_partkey % 200 AS name").distinct()
    return X.covered_base(rows, names("A"), names("R")).select("package", "base_covered")


@query("SELECT package, name, ran, row_number() OVER (PARTITION BY package ORDER BY ran, ord) AS place FROM (SELECT p_brand AS package, p_partkey AS ord, 'N' || p_partkey AS name, p_partkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) AS ran FROM part)")
def r13_covered_last(spark, d):
    """Untested exports that a run executed come after the others."""
    names = table(spark, d, "part").selectExpr("p_brand AS package", "p_partkey AS ord", "'N' || p_partkey AS name")
    ran = table(spark, d, "customer").where("c_acctbal > 0").selectExpr("c_custkey AS p_partkey").join(table(spark, d, "part"), "p_partkey")
    return X.covered_last(names, ran.selectExpr("p_brand AS package", "'N' || p_partkey AS name")).select("package", "name", "ran", "place")


_CAND = ["l_suppkey AS package", "CASE l_linenumber WHEN 1 THEN 'dup_blocks' WHEN 2 THEN 'untested_exports' ELSE 'globals' END AS metric", "l_orderkey * 10 + l_linenumber AS ord", "CASE WHEN l_quantity < 5 THEN '' ELSE 'f' || (l_partkey % 9) || '.go' END AS file", "CAST(l_quantity AS BIGINT) AS line", "l_shipdate >= TIMESTAMP '2001-06-01 00:00:00' AS changed"]
_METRICS = ("dup_blocks", "untested_exports", "globals", "fan_in")


@query(
    f"""WITH c AS (SELECT {', '.join(_CAND)} FROM lineitem), t AS (SELECT DISTINCT package, file FROM c WHERE changed),
k AS (SELECT c.*, t.file IS NULL AS untouched FROM c LEFT JOIN t USING (package, file) WHERE file <> ''),
b AS (SELECT package, metric, arg_min(file, (untouched, ord, file, line)) AS nf, arg_min(line, (untouched, ord, file, line)) AS nl, arg_min(file, (ord, file, line)) AS ff, arg_min(line, (ord, file, line)) AS fl FROM k GROUP BY ALL),
f AS (SELECT package, arg_min(file, (ord, file)) AS fall FROM k GROUP BY package)
SELECT s_suppkey AS package, m.metric, coalesce(CASE WHEN s_suppkey % 2 = 0 THEN ff ELSE nf END, fall) AS file, CASE WHEN nf IS NOT NULL THEN CASE WHEN s_suppkey % 2 = 0 THEN fl ELSE nl END WHEN fall IS NOT NULL THEN 1 END AS line
FROM supplier CROSS JOIN (VALUES {', '.join(f"('{m}')" for m in _METRICS)}) m(metric) LEFT JOIN b ON b.package = s_suppkey AND b.metric = m.metric LEFT JOIN f ON f.package = s_suppkey"""
)
def g16_located(spark, d):
    """Findings on the first candidate in a changed file, or the first, or the package's first file."""
    c = table(spark, d, "lineitem").selectExpr(*_CAND)
    findings = table(spark, d, "supplier").select(F.col("s_suppkey").alias("package"), F.explode(F.array(*map(F.lit, _METRICS))).alias("metric"), (F.col("s_suppkey") % 2 == 0).alias("lead"))
    return X.located(findings, c, c.where("changed"), c.where("file <> ''")).drop("lead")


@query(r"SELECT doc_id, regexp_extract(t, '^(.+):(\d+)-(\d+)$', 1) AS file, CAST(regexp_extract(t, '^(.+):(\d+)-(\d+)$', 2) AS BIGINT) AS start, CAST(regexp_extract(t, '^(.+):(\d+)-(\d+)$', 3) AS BIGINT) AS stop FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN source || ':x.go:' || doc_id || '-' || n_chars WHEN 1 THEN source || '.go:' || doc_id WHEN 2 THEN ':1-2' ELSE 'a/' || lang || ':' || doc_id || '-' || (doc_id + 3) END AS t FROM documents) WHERE regexp_matches(t, '^(.+):(\d+)-(\d+)$')")
def r12_spans(spark, d):
    """`file:start-end` texts; those of another shape are left out."""
    t = "CASE doc_id % 4 WHEN 0 THEN source || ':x.go:' || doc_id || '-' || n_chars WHEN 1 THEN source || '.go:' || doc_id WHEN 2 THEN ':1-2' ELSE 'a/' || lang || ':' || doc_id || '-' || (doc_id + 3) END"
    return table(spark, d, "documents").select("doc_id", X.span(F.expr(t)).alias("s")).where("s is not null").select("doc_id", "s.*")
