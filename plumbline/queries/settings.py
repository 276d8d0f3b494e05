"""Configuration as rows: conditions, rule shapes, versions, corpora's exclusions; parts and orders stand for them."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.plans import config as C
from plumbline.queries.registry import registry
from plumbline.sources.host import table

QUERIES, SQL, query = registry()

_COND = "CASE p_partkey % 7 WHEN 0 THEN ' sloc > ' || p_size WHEN 1 THEN 'has_tests>1.5e2' WHEN 2 THEN 'a b > 3' WHEN 3 THEN 'sloc >= 3' WHEN 4 THEN 'sloc > x' WHEN 5 THEN 'tokens >-' || p_size || '.5 ' ELSE 'sloc' END"


@query(f"SELECT p_partkey, regexp_extract(t, '{C._CONDITION}', 1) AS metric, CAST(regexp_extract(t, '{C._CONDITION}', 2) AS DOUBLE) AS value FROM (SELECT p_partkey, {_COND} AS t FROM part) WHERE regexp_matches(t, '{C._CONDITION}')")
def p8_conditions(spark, d):
    """`metric > number`; what isn't one is left out."""
    return table(spark, d, "part").select("p_partkey", C.condition(F.expr(_COND)).alias("c")).where("c is not null").select("p_partkey", "c.*")


_KNOWN = ["sloc", "tokens_est", "changed_func_cognitive_max"]
_RULE = [
    "p_partkey AS id",
    "CASE p_size % 7 WHEN 0 THEN '' WHEN 1 THEN 'nope' WHEN 2 THEN 'changed_func_cognitive_max' ELSE 'sloc' END AS metric",
    "CASE p_partkey % 5 WHEN 0 THEN 'density' WHEN 1 THEN 'capacity' WHEN 2 THEN 'requirement' WHEN 3 THEN '' ELSE 'odd' END AS kind",
    "CASE p_size % 4 WHEN 0 THEN 'fail' WHEN 1 THEN 'warn' WHEN 2 THEN '' ELSE 'bad' END AS severity",
    "CASE WHEN p_size % 3 = 0 THEN NULL ELSE CAST(p_size - 5 AS DOUBLE) END AS max",
    "CASE WHEN p_partkey % 4 = 0 THEN 1.0 END AS max_delta",
    "CASE WHEN p_partkey % 8 = 0 THEN 2.0 END AS floor",
    "CASE p_partkey % 9 WHEN 0 THEN -1.0 WHEN 1 THEN 1.0 END AS over_max_delta",
    "(p_size % 5) / 4.0 AS warn_at",
    "p_partkey % 7 = 0 AS ratchet",
    "CASE WHEN p_partkey % 6 = 0 THEN true END AS require",
    "p_size % 10 AS r",
]
_OR = ("AND", "OR", "IN", "NOT")


@query(
    f"WITH t AS (SELECT {', '.join(_RULE)} FROM part), k AS (SELECT *, metric IN ({', '.join(repr(m) for m in _KNOWN)}) AS known, r = 0 AS bad_roles, r = 1 AS twice FROM t) "
    + "SELECT id, concat_ws('; ', " + ", ".join(f"CASE WHEN {test} THEN '{text}' END" for test, text in C.SHAPE) + ") AS errors FROM k"
)
def p9_rule_errors(spark, d):
    """Everything that is wrong with the shape of each rule."""
    roles = F.when(F.col("r") == 0, F.array(F.lit("main"), F.lit("boss"))).when(F.col("r") == 1, F.array(F.lit("main"), F.lit("main"))).otherwise(F.array(F.lit("library")))
    rows = table(spark, d, "part").selectExpr(*_RULE).withColumn("roles", roles)
    return C.rule_errors(rows, _KNOWN).select("id", F.array_join("errors", "; ").alias("errors"))


_VERSION = "CASE o_orderkey % 5 WHEN 0 THEN 'rebuild-x' WHEN 1 THEN 'thresholds-' || CAST(2026 - o_orderkey % 2 AS {string}) || '-' || CASE WHEN o_custkey % 13 = 0 THEN '13' ELSE lpad(CAST(o_custkey % 12 + 1 AS {string}), 2, '0') END || '-' || lpad(CAST(o_custkey % 28 + 1 AS {string}), 2, '0') || '+typescript' WHEN 2 THEN 'thresholds-2027-01-01' WHEN 3 THEN 'thresholds-2026' ELSE 'draft' END"


@query(f"SELECT o_orderkey, starts_with(v, 'rebuild-') OR (starts_with(v, 'thresholds-') AND length(substr(v, 12, 10)) = 10 AND try_strptime(substr(v, 12, 10), '%Y-%m-%d') IS NOT NULL AND substr(v, 12, 10) > '{C.FIT_DATE}') AS calibrated FROM (SELECT o_orderkey, {_VERSION.replace('{string}', 'VARCHAR')} AS v FROM orders)")
def p18_calibrated(spark, d):
    """Whether a configuration version carries measured parameters."""
    return table(spark, d, "orders").select("o_orderkey", C.is_calibrated(F.expr(_VERSION.replace("{string}", "STRING"))).alias("calibrated"))


_PATH = "CASE p_size % 6 WHEN 0 THEN 'src/' || p_name WHEN 1 THEN 'docs/' || p_brand WHEN 2 THEN 'a/runtime-tests/x' WHEN 3 THEN 'lib/testing' WHEN 4 THEN 'x/dts_spec.d/y' ELSE 'pkg/' || p_type END"
_SEG = "'(^|/)(" + "|".join(C.EXCLUDED_SEGMENTS) + ")(/|$)'"
_WORD = "'(^|[/._-])(" + "|".join(C.EXCLUDED_WORDS) + ")([/._-]|$)'"


@query(f"SELECT p_partkey, regexp_matches(p, {_SEG}) OR regexp_matches(p, {_WORD}) AS excluded FROM (SELECT p_partkey, {_PATH} AS p FROM part)")
def p22_excluded_packages(spark, d):
    """Packages under test, example or documentation directories."""
    return table(spark, d, "part").select("p_partkey", C.excluded_package(F.expr(_PATH)).alias("excluded"))
