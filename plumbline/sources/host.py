"""Maps the driver's tables onto package metrics, so that the operators have whole tables to work on.

A package is a supplier; its metrics are aggregates of its line items, at head over all of them and at base
over those shipped before 1999. The expressions are valid in Spark and in DuckDB, so that both sides of a
comparison measure the same packages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.sources.shared import attach

CUT = "1999-01-01"

_QTY = "CAST(l_quantity AS BIGINT)"

#: metric -> expression over one supplier's line items
METRICS = {
    "files": "count(DISTINCT l_orderkey)",
    "sloc": f"CAST(sum({_QTY}) AS BIGINT)",
    "largest_file_sloc": f"max({_QTY}) * 12",
    "tokens_est": f"CAST(sum({_QTY}) AS BIGINT) * 2",
    "tokens_est_with_tests": f"CAST(sum({_QTY}) AS BIGINT) * 2 + count(*) * 3",
    "internal_imports": "count(DISTINCT l_partkey) % 14",
    "external_imports": "count(DISTINCT l_partkey) % 9",
    "fan_in": "count(DISTINCT l_orderkey) % 31",
    "exported_symbols": "count(DISTINCT l_partkey) % 97",
    "untested_exports": "count(*) FILTER (WHERE l_returnflag = 'A') % 23",
    "globals": "count(*) FILTER (WHERE l_linenumber = 7) % 5",
    "init_funcs": "count(*) FILTER (WHERE l_linenumber = 6 AND l_returnflag = 'R') % 3",
    "max_nesting": "count(*) % 9",
    "cognitive_p90": f"CAST(sum({_QTY}) AS BIGINT) % 45",
    "func_count": "count(*) % 50",
    "dup_blocks": "count(*) FILTER (WHERE l_discount >= 0.09) % 13",
    "duplication_pct": "CAST(count(*) FILTER (WHERE l_discount >= 0.05) * 100 % 64 AS DOUBLE)",
    "test_files": "count(*) % 4",
    "has_tests": "count(*) % 2",
    "abstract_types": "count(DISTINCT l_partkey) % 7",
    "types": "count(DISTINCT l_partkey) % 7 + count(*) % 5",
    "duplicated_lines": f"CASE WHEN l_suppkey % 6 = 0 THEN NULL ELSE CAST(sum({_QTY}) AS BIGINT) % 700 END",
    "documented_exports": "CASE WHEN l_suppkey % 7 = 0 THEN NULL ELSE CAST(floor((count(DISTINCT l_partkey) % 97) / 2) AS BIGINT) END",
    "coverage_pct": f"CASE WHEN l_suppkey % 3 = 0 THEN NULL ELSE CAST(CAST(sum({_QTY}) AS BIGINT) % 101 AS DOUBLE) END",
    "changed_func_cognitive_max": f"CASE WHEN l_suppkey % 4 = 0 THEN NULL ELSE CAST(sum({_QTY}) AS BIGINT) % 73 END",
    "churn_commits": "CASE WHEN l_suppkey % 5 = 0 THEN NULL ELSE count(*) % 40 END",
}
ROLE = "CASE l_suppkey % 5 WHEN 0 THEN 'library' WHEN 1 THEN '' WHEN 2 THEN 'main' WHEN 3 THEN 'test-support' ELSE 'generated-only' END"


def package_metrics(spark: SparkSession, sf_dir: str, base: bool = False) -> DataFrame:
    """package, role and one column for each of METRICS."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    if base:
        rows = rows.where(f"l_shipdate < TIMESTAMP '{CUT} 00:00:00' AND l_suppkey % 11 <> 0")
    named = [F.expr(e).alias(m) for m, e in METRICS.items()]
    out = rows.groupBy("l_suppkey").agg(*named)
    return out.select(F.concat(F.lit("pkg"), F.col("l_suppkey").cast("string")).alias("package"), F.expr(ROLE).alias("role"), *METRICS)


def metrics_sql(base: bool = False) -> str:
    """The same frame as a DuckDB subquery."""
    where = f"WHERE l_shipdate < TIMESTAMP '{CUT} 00:00:00' AND l_suppkey % 11 <> 0" if base else ""
    cols = ", ".join(f"{e} AS {m}" for m, e in METRICS.items())
    return f"(SELECT 'pkg' || CAST(l_suppkey AS VARCHAR) AS package, {ROLE} AS role, {cols} FROM lineitem {where} GROUP BY l_suppkey)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    attach(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
