"""Choosing packages for experiments, from parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import scalar as S
from plumbline.operators import selection as X
from plumbline.queries.registry import registry
from plumbline.sources.host import table

QUERIES, SQL, query = registry()
P = S.RebuildParams()

_ROW = [
    "p_partkey AS ord", "p_brand AS module", "p_brand || '/' || p_partkey AS package", "CASE WHEN p_brand = 'Brand#3' THEN NULL ELSE 'r' END AS repo",
    "CASE p_size % 11 WHEN 0 THEN NULL WHEN 1 THEN true ELSE false END AS uses_cgo", "CASE p_size % 9 WHEN 0 THEN NULL WHEN 1 THEN 2 ELSE 0 END AS generated_files",
    "p_partkey % 13 AS func_count", "p_partkey % 3 <> 0 AS has_tests", "p_partkey % 4 AS fan_in", "p_partkey % 2 AS fan_in_tests", "CAST(p_size * 3000 AS DOUBLE) AS rebuild_tokens",
]
_RAW = f"(CASE WHEN rebuild_tokens / {P.context_budget} > 1 THEN pow(rebuild_tokens / {P.context_budget}, {P.exponent}) ELSE rebuild_tokens / {P.context_budget} END)"
_PASSES = f"round({_RAW} * 10) / 10"
_OK = f"""WITH r AS (SELECT *, {_PASSES} AS agent_passes FROM (SELECT {', '.join(_ROW)} FROM part)),
ok AS (SELECT * FROM r WHERE repo IS NOT NULL AND NOT uses_cgo AND generated_files = 0 AND func_count > 0 AND agent_passes <= 3.5 AND (has_tests OR fan_in + fan_in_tests > 0))"""


def _eligible(spark, d):
    rows = table(spark, d, "part").selectExpr(*_ROW)
    rows = rows.withColumn("agent_passes", S.round_to(S.agent_passes(F.col("rebuild_tokens"), P), 1))
    return X.eligible(rows, 3.5)


@query(_OK + " SELECT ord, agent_passes FROM ok")
def p23_candidates(spark, d):
    """The packages that experiments may take."""
    return X.recomputed(_eligible(spark, d), P).select("ord", "agent_passes")


_STRATA = _OK + f""", t AS (SELECT *, CASE WHEN rebuild_tokens / {P.context_budget} <= 1 THEN 'ONE_PASS' WHEN {_RAW} <= {P.few_passes_max} THEN 'FEW_PASSES' ELSE 'PARTITION' END || CASE WHEN has_tests THEN '/tested' ELSE '/untested' END AS stratum FROM ok),
s AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY round(rebuild_tokens), package) - 1 AS place, count(*) OVER (PARTITION BY stratum) AS size FROM t)"""


@query(_STRATA + " SELECT ord, stratum, place, size FROM s")
def w11_strata(spark, d):
    """Each stratum's candidates in the order that slots walk."""
    return X.strata(X.recomputed(_eligible(spark, d), P)).select("ord", "stratum", "place", "size")


@query()
def w11_selected(spark, d):
    """The slots' verdicts in order; the tests hold them against a plain loop."""
    from plumbline.sources.shared import ensure_shared

    ensure_shared(spark)
    placed = X.strata(X.recomputed(_eligible(spark, d), P)).checkpoint()
    rule = X.SelectionRule((("ONE_PASS/tested", 4), ("ONE_PASS/untested", 3), ("FEW_PASSES/tested", 4), ("FEW_PASSES/untested", 2)), 1)
    verdicts = X.select(placed, rule, lambda r: r["ord"] % 5 != 0)
    return spark.createDataFrame([(i, v["stratum"], v["slot"], v["module"], v["package"], v["ok"]) for i, v in enumerate(verdicts)], "ord int, stratum string, slot int, module string, package string, ok boolean")


_TREE = ["l_returnflag AS module", "CASE WHEN l_partkey % 97 = 0 THEN '.' WHEN l_partkey % 3 = 0 THEN 'a' || (l_partkey % 7) WHEN l_partkey % 3 = 1 THEN 'a' || (l_partkey % 7) || '/b' || (l_partkey % 5) ELSE 'a' || (l_partkey % 7) || '/b' || (l_partkey % 5) || '/c' || (l_partkey % 4) END AS package"]


@query(
    f"""WITH p AS (SELECT module, package, CAST(sum(q) AS DOUBLE) * 2 AS rebuild_tokens, max(k) % 41 = 0 AS bad, min(k) % 23 = 0 AS is_main FROM (SELECT {', '.join(_TREE)}, CAST(l_quantity AS BIGINT) AS q, l_partkey AS k FROM lineitem) GROUP BY ALL),
kn AS (SELECT * FROM p WHERE NOT is_main AND package <> '.'),
t AS (SELECT r.module, r.package AS root, count(*) AS packages, CAST(sum(CAST(round(m.rebuild_tokens) AS BIGINT)) AS BIGINT) AS tokens, bool_or(m.bad) AS bad FROM kn r JOIN kn m ON m.module = r.module AND (m.package = r.package OR starts_with(m.package, r.package || '/')) GROUP BY ALL)
SELECT module, root, packages, tokens FROM t WHERE NOT bad AND packages BETWEEN 2 AND 30 AND CASE WHEN tokens / {P.context_budget} > 1 THEN pow(tokens / {P.context_budget}, {P.exponent}) ELSE tokens / {P.context_budget} END <= 40"""
)
def c14_trees(spark, d):
    """Packages that, with all below them, make a tree of the asked size."""
    rows = table(spark, d, "lineitem").selectExpr(*_TREE, "CAST(l_quantity AS BIGINT) AS q", "l_partkey AS k")
    p = rows.groupBy("module", "package").agg((F.sum("q").cast("double") * 2).alias("rebuild_tokens"), (F.max("k") % 41 == 0).alias("uses_cgo"), (F.min("k") % 23 == 0).alias("is_main"), F.lit(0).alias("generated_files"))
    return X.trees(p, P, 2, 30, 40.0).select("module", "root", "packages", "tokens")
