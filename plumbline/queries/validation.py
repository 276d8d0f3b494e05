"""The gate against labels: orders are commits, their status the label, line items what fired."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import measure as M
from plumbline.plans.rules import SHIPPED, TYPESCRIPT, rule_views, views_table
from plumbline.queries.registry import registry
from plumbline.sources.host import table

QUERIES, SQL, query = registry()
LANGS = {"typescript": TYPESCRIPT}
FOUND, VIEWS = rule_views(SHIPPED, LANGS)
N = len(SHIPPED)
_RULES = "(SELECT * FROM (VALUES " + ", ".join(f"({i}, {r.severity == 'warn'})" for i, r in enumerate(SHIPPED)) + ") t(rule, warns))"
_VIEWS = "(SELECT * FROM (VALUES " + ", ".join(f"({i}, {'NULL' if n is None else repr(n)}, {p}, '{FOUND[i][1].metric}', [{', '.join(repr(x) for x in FOUND[i][1].roles)}]::VARCHAR[], {FOUND[i][1].metric == 'dup_blocks_cross_pkg'})" for n, p, i in VIEWS) + ") t(rule, language, place, metric, roles, wide))"

_FIRED = "SELECT DISTINCT l_orderkey AS commit, l_suppkey % {n} AS rule FROM lineitem WHERE l_discount > 0.08"
_BASE = f"""WITH c AS (SELECT o_orderkey AS commit, o_orderstatus = 'F' AS block FROM orders), r AS {_RULES}, f AS ({_FIRED.format(n=N)}), x AS (SELECT f.*, warns FROM f JOIN r USING (rule)),
re AS (SELECT DISTINCT l_orderkey AS commit, l_suppkey % 4 AS rule FROM lineitem WHERE l_tax > 0.07)"""


def _rates(rel, keys):
    s = lambda n, d: f"CASE WHEN {d} = 0 THEN 0.0 ELSE CAST({n} AS DOUBLE) / {d} END"
    return f"SELECT *, {s('block_failed', 'blocks')} AS recall, {s('allow_failed', 'allows')} AS false_failure, CASE WHEN block_failed + allow_failed > 0 THEN CAST(block_failed AS DOUBLE) / (block_failed + allow_failed) END AS precision, {s('block_failed', 'blocks')} - {s('allow_failed', 'allows')} AS j FROM (SELECT {keys}, count(*) FILTER (block) AS blocks, count(*) FILTER (NOT block) AS allows, count(*) FILTER (block AND failed) AS block_failed, count(*) FILTER (NOT block AND failed) AS allow_failed FROM ({rel}) GROUP BY {keys})"


def _facts(spark, d):
    commits = table(spark, d, "orders").selectExpr("o_orderkey AS commit", "o_orderstatus = 'F' AS block")
    items = table(spark, d, "lineitem")
    fired = items.where("l_discount > 0.08").selectExpr("l_orderkey AS commit", f"CAST(l_suppkey % {N} AS INT) AS rule")
    again = items.where("l_tax > 0.07").selectExpr("l_orderkey AS commit", "CAST(l_suppkey % 4 AS INT) AS rule")
    rules = spark.createDataFrame([(i, r.severity == "warn") for i, r in enumerate(SHIPPED)], "ord int, warns boolean")
    return commits, fired, again, rules


_ROW = ["l_orderkey * 10 + l_linenumber AS row", "CASE WHEN l_partkey % 20 = 0 THEN '<module>' ELSE 'p' || l_suppkey END AS package", "CASE l_returnflag WHEN 'A' THEN 'go' WHEN 'N' THEN 'typescript' ELSE 'py' END AS language", "CASE l_linenumber % 4 WHEN 0 THEN '' WHEN 1 THEN 'main' WHEN 2 THEN 'test-support' ELSE 'generated-only' END AS role", "[{metrics}][CAST(l_suppkey % {n} AS INT) + {one}] AS metric"]
_NAMES = ", ".join(f"'{r.metric}'" for r in SHIPPED)


@query(f"WITH t AS (SELECT DISTINCT {', '.join(_ROW).format(metrics=_NAMES, n=N, one=1)} FROM lineitem), v AS {_VIEWS} SELECT t.*, arg_min(v.rule, v.place) AS rule FROM t JOIN v ON v.metric = t.metric AND v.language IS NOT DISTINCT FROM CASE WHEN t.language IN (SELECT language FROM v WHERE language IS NOT NULL) THEN t.language END WHERE v.wide = (t.package = '<module>') AND (len(v.roles) = 0 OR list_contains(v.roles, coalesce(nullif(t.role, ''), 'library'))) GROUP BY ALL")
def j29_judging_rule(spark, d):
    """The rule that judges a metric on a row, by language, role and kind of row."""
    metric = F.element_at(F.array(*[F.lit(r.metric) for r in SHIPPED]), (F.col("l_suppkey") % N + 1).cast("int")).alias("metric")
    rows = table(spark, d, "lineitem").select(*[F.expr(x) for x in _ROW[:-1]], metric).distinct()
    return M.judged_by(rows, views_table(spark, SHIPPED, LANGS))


@query(_BASE + " " + _rates("SELECT 'gate' AS view, c.block, coalesce(q.n, 0) > 0 AS failed FROM c LEFT JOIN (SELECT commit, count(*) AS n FROM x WHERE NOT warns GROUP BY commit) q USING (commit)", "view"))
def c9_gate(spark, d):
    """The gate's rates, rules that warn left out."""
    commits, fired, _, rules = _facts(spark, d)
    return M.gate_rates(fired, commits, rules)


@query(_BASE + ", g AS (SELECT c.commit, c.block, s.rule, r.warns, coalesce(q.n, 0) - CASE WHEN o.commit IS NOT NULL AND NOT r.warns THEN 1 ELSE 0 END AS others, a.commit IS NOT NULL AS again FROM c CROSS JOIN (SELECT DISTINCT rule FROM re) s JOIN r USING (rule) LEFT JOIN (SELECT commit, count(*) AS n FROM x WHERE NOT warns GROUP BY commit) q ON q.commit = c.commit LEFT JOIN x o ON o.commit = c.commit AND o.rule = s.rule LEFT JOIN re a ON a.commit = c.commit AND a.rule = s.rule) " + _rates("SELECT rule, block, others > 0 OR (again AND NOT warns) AS failed FROM g", "rule"))
def c9_swapped(spark, d):
    """The gate's rates with each of four rules replaced, the others as recorded."""
    commits, fired, again, rules = _facts(spark, d)
    return M.swapped_rates(fired, again, commits, rules)


@query(_BASE + ", q AS (SELECT commit, count(*) FILTER (NOT warns) AS n FROM x GROUP BY commit), o AS (SELECT x.commit, x.rule FROM x JOIN q USING (commit) WHERE n - CASE WHEN warns THEN 0 ELSE 1 END = 0) " + _rates("SELECT r.rule, c.block, o.commit IS NOT NULL AS failed FROM c CROSS JOIN r LEFT JOIN o ON o.commit = c.commit AND o.rule = r.rule", "rule"))
def a28_alone(spark, d):
    """Each rule on the commits that no other failing rule fired on."""
    commits, fired, _, rules = _facts(spark, d)
    return M.alone(fired, commits, rules)


@query(_BASE + " SELECT commit FROM c WHERE block AND commit NOT IN (SELECT commit FROM x WHERE NOT warns)")
def a28_missed(spark, d):
    """Blocked commits that the gate passes."""
    commits, fired, _, rules = _facts(spark, d)
    return M.missed(fired, commits, rules)


@query(_BASE + " SELECT rule, count(*) AS commits FROM f GROUP BY rule")
def a28_judged(spark, d):
    """How many commits have a row that the rule judges."""
    return M.judged(_facts(spark, d)[1])


_BR = ["l_orderkey AS commit", "l_suppkey % 6 AS rule", "CASE WHEN l_suppkey % 6 = 5 THEN NULL ELSE 20.0 END AS max", "CASE WHEN l_linenumber = 1 THEN NULL ELSE l_quantity END AS base"]


@query(f"WITH b AS (SELECT {', '.join(_BR)} FROM lineitem WHERE l_discount > 0.05), p AS (SELECT commit, rule, bool_and(coalesce(base > max, false)) AS over FROM b WHERE max IS NOT NULL GROUP BY ALL) SELECT rule, count(*) FILTER (o_orderstatus = 'F') AS block_fired, count(*) FILTER (o_orderstatus <> 'F') AS allow_fired, count(*) FILTER (o_orderstatus = 'F' AND over) AS block_over, count(*) FILTER (o_orderstatus <> 'F' AND over) AS allow_over FROM p JOIN orders ON o_orderkey = commit GROUP BY rule")
def a28_legacy(spark, d):
    """Commits a rule fired on, and those that were over its max at the parent already."""
    return M.legacy(table(spark, d, "lineitem").where("l_discount > 0.05").selectExpr(*_BR), _facts(spark, d)[0])


@query(_BASE + ", m AS (SELECT l_orderkey AS commit, max(CAST(l_quantity AS BIGINT) * 3) AS most FROM lineitem WHERE l_partkey % 20 <> 0 GROUP BY ALL) " + _rates("SELECT setting, block, coalesce(most > setting, false) AS failed FROM c LEFT JOIN m USING (commit) CROSS JOIN (VALUES (50), (100), (140)) s(setting)", "setting"))
def a28_size(spark, d):
    """The rule that looks at growth alone, at three settings."""
    rows = table(spark, d, "lineitem").selectExpr("l_orderkey AS commit", "CASE WHEN l_partkey % 20 = 0 THEN '<module>' ELSE 'p' END AS package", "CAST(l_quantity AS BIGINT) * 3 AS sloc_delta")
    return M.size_rates(rows, _facts(spark, d)[0], [50, 100, 140])


@query("SELECT count(*) AS checked, count(*) FILTER ((l_discount > 0.05) <> (l_tax > 0.04)) AS mismatched FROM lineitem WHERE l_suppkey % 7 <> 0 AND l_partkey % 9 <> 0")
def a28_recheck(spark, d):
    """Recorded breaches against the rules evaluated again."""
    return M.recheck(table(spark, d, "lineitem").selectExpr("l_suppkey % 7 = 0 AS candidate", "l_partkey % 9 = 0 AS reevaluated", "l_discount > 0.05 AS recorded", "l_tax > 0.04 AS refired"))


_COM = "SELECT doc_id AS hash, 'v1' AS version, n_chars % 9 <> 0 AS loaded FROM documents"
_LBL = "SELECT doc_id AS hash, CASE WHEN quality = 0 THEN 'block' ELSE 'allow' END AS verdict, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE doc_id % 3 <> 0 END AS agent FROM labels WHERE quality IS NOT NULL"
_PKG = "SELECT o_orderkey % 1500 AS hash, 'p' || (o_custkey % 7) AS package, CASE WHEN o_totalprice > 400000 THEN 2 ELSE 0 END AS violations, o_custkey % 6 = 0 AS unavailable FROM orders"


def _corpus(spark, d):
    rows = table(spark, d, "orders").selectExpr("o_orderkey % 1500 AS hash", "'p' || (o_custkey % 7) AS package", "CASE WHEN o_totalprice > 400000 THEN 2 ELSE 0 END AS violations", "o_custkey % 6 = 0 AS unavailable")
    had = rows.groupBy("hash").agg(F.sum("violations").alias("v"))
    commits = table(spark, d, "documents").selectExpr("doc_id AS hash", "'v1' AS version", "n_chars % 9 <> 0 AS loaded").join(had, "hash", "left").withColumn("passed", F.coalesce(F.col("v") == 0, F.lit(True))).drop("v")
    labels = table(spark, d, "labels").where("quality is not null").selectExpr("doc_id AS hash", "CASE WHEN quality = 0 THEN 'block' ELSE 'allow' END AS verdict", "CASE WHEN doc_id % 5 = 0 THEN NULL ELSE doc_id % 3 <> 0 END AS agent")
    return M.load_corpus(commits, labels, rows, agent_only=True)


_LOADED = f"WITH c AS ({_COM}), l AS ({_LBL}), p AS ({_PKG}) SELECT hash, verdict = 'block' AS block, coalesce(sum(violations) FILTER (NOT unavailable), 0) = 0 AS passed, count(package) FILTER (NOT unavailable) AS kept, count(package) FILTER (unavailable) AS set_aside FROM c JOIN l USING (hash) LEFT JOIN p USING (hash) WHERE loaded AND coalesce(agent, true) GROUP BY hash, verdict"


@query(_LOADED)
def j18_loaded_corpus(spark, d):
    """Labels meet the replay; unavailable rows are set aside and the verdict is that of the rest."""
    return _corpus(spark, d)


@query(f"WITH k AS ({_LOADED}) SELECT k.hash, s.toxic = 1 AS block, k.passed FROM k JOIN labels s ON s.doc_id = k.hash")
def j19_relabelled(spark, d):
    """The same commits under a second set of labels."""
    second = table(spark, d, "labels").selectExpr("doc_id AS hash", "CASE WHEN toxic = 1 THEN 'block' ELSE 'allow' END AS verdict")
    return M.relabelled(_corpus(spark, d), second).select("hash", "block", "passed")


@query(f"WITH k AS ({_LOADED}) SELECT CASE GROUPING(name) WHEN 0 THEN name END AS name, count(*) FILTER (block) AS block, count(*) FILTER (NOT block) AS allow, CAST(sum(set_aside) AS BIGINT) AS set_aside FROM (SELECT *, 'c' || (hash % 4) AS name FROM k) GROUP BY ROLLUP (name)")
def a30_pooled(spark, d):
    """What each corpus counts, and all of them pooled."""
    return M.pooled_counts(_corpus(spark, d).withColumn("name", F.concat(F.lit("c"), (F.col("hash") % 4).cast("string"))))
