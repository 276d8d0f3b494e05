"""Reports over the supplier packages' findings, rankings and deltas."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import gate, packages, rank
from plumbline.queries import rank_gate as G
from plumbline.queries.registry import registry
from plumbline.sinks import report as R
from plumbline.sources.host import metrics_sql, package_metrics, table

QUERIES, SQL, query = registry()
_num, _r = G._num, G._r
BOOLS = ", ".join(f"'{b}'" for b in R.BOOLEANS)


def _findings(spark, d):
    return gate.exempt(gate.merge_findings(G._findings(spark, d)), G._exemptions(spark), G.TODAY)


def _value(v):
    return f"(CASE WHEN metric IN ({BOOLS}) THEN CASE WHEN {v} <> 0 THEN 'true' ELSE 'false' END ELSE {_num(_r(v, 2))} END)"


_TEXT = f"metric || ': ' || CASE WHEN has_base THEN {_value('base')} || ' -> ' || {_value('head')} ELSE {_value('head')} || CASE WHEN metric = 'changed_func_cognitive_max' THEN ' (changed since baseline)' ELSE ' (no baseline)' END END || ', ' || label || '.'"
_LINE = f"{_TEXT} || CASE WHEN reason IS NOT NULL THEN ' Exempted: ' || reason ELSE '' END"


@query(f"{G._MGX} SELECT package, CASE WHEN reason IS NOT NULL THEN 'exempted' WHEN kind = 'violation' THEN 'violations' ELSE 'warnings' END AS section, ord, {_LINE} AS line FROM mx")
def k2_check_lines(spark, d):
    """Every finding as the line a check shows, by section."""
    return R.lines_of(_findings(spark, d))


@query(f"{G._MGX}, c AS (SELECT h.package, b.package IS NULL AS new, count(mx.ord) FILTER (kind = 'violation' AND reason IS NULL) AS v, count(mx.ord) FILTER (kind = 'warning' AND reason IS NULL) AS w, count(reason) AS x FROM hm h LEFT JOIN bm b ON b.package = h.package LEFT JOIN mx ON mx.package = h.package GROUP BY ALL) SELECT package, package || ': ' || v || ' violation' || CASE WHEN v = 1 THEN '' ELSE 's' END || ', ' || w || ' warning' || CASE WHEN w = 1 THEN '' ELSE 's' END || ', ' || x || ' exempted' || CASE WHEN new THEN ', new since baseline' ELSE '' END AS line FROM c")
def k2_summaries(spark, d):
    """K2: a check's summary line for each package."""
    head = package_metrics(spark, d).select("package")
    counts = gate.verdicts(_findings(spark, d), head)
    had = package_metrics(spark, d, base=True).select("package", F.lit(False).alias("old"))
    met = counts.join(had, "package", "left")
    return met.select("package", R.summary_line(F.col("package"), F.col("violations"), F.col("warnings"), F.col("exempted"), F.col("old").isNull()).alias("line"))


_CMD = f"""{G._MGX}, a AS (SELECT package, ord, metric, CASE WHEN reason IS NOT NULL THEN 'notice' WHEN kind = 'violation' THEN 'error' ELSE 'warning' END AS what, replace({_LINE}, '%', '%25') AS text FROM mx)
SELECT package, ord, metric, what, '::' || what || ' file=' || package || '::' || text AS command FROM (SELECT *, row_number() OVER (PARTITION BY what ORDER BY package, ord, metric) AS rn FROM a) WHERE what = 'notice' OR rn <= 10"""


@query(_CMD)
def k3_annotations(spark, d):
    """K3: the ten errors and ten warnings that are annotated, and every notice."""
    rows = _findings(spark, d).withColumn("file", F.lit(None).cast("string")).withColumn("line", F.lit(None).cast("bigint"))
    return R.annotations(rows).drop("at")


@query(f"{G._MGX} SELECT CASE WHEN kind = 'violation' THEN 'error' ELSE 'warning' END AS what, least(count(*), 10) AS shown, greatest(count(*) - 10, 0) AS hidden FROM mx WHERE reason IS NULL GROUP BY ALL")
def k3_omitted(spark, d):
    """K3: how many findings the cap leaves out."""
    return R.omitted(_findings(spark, d))


_JSON_KEYS = ["tier", "fan_in"]
_JSON_METRICS = ["files", "sloc", "duplicated_lines", "churn_commits", "has_tests"]


def _pairs_sql(names):
    return ", ".join(f"'\"{n}\":' || coalesce(CAST({n} AS VARCHAR), 'null')" for n in names)


@query(f"WITH {G._EST} SELECT package, '{{\"package\":\"' || package || '\",\"tier\":\"' || tier || '\",\"fan_in\":' || fan_in || ',\"metrics\":{{' || concat_ws(',', {_pairs_sql(_JSON_METRICS)}) || '}}}}' AS report FROM e")
def k1_report_json(spark, d):
    """K1: every package's report, keys in a fixed order, unknown metrics null."""
    return R.package_json(rank.estimates(package_metrics(spark, d), G.P), _JSON_KEYS, _JSON_METRICS)


_COUNTS = ["sloc", "files", "dup_blocks", "duplicated_lines", "churn_commits"]


@query("SELECT package, '{' || concat_ws(',', " + ", ".join(f"'\"{m}\":' || coalesce(CAST(CAST(h.{m} - coalesce(b.{m}, 0) AS BIGINT) AS VARCHAR), 'null')" for m in _COUNTS) + ", '\"duplication_pct\":' || coalesce(CAST(h.duplication_pct - coalesce(b.duplication_pct, 0) AS VARCHAR), 'null')) || '}' AS deltas FROM " + f"{metrics_sql()} h LEFT JOIN {metrics_sql(True)} b USING (package)")
def x13_deltas_json(spark, d):
    """What changed, as JSON: whole numbers for counts, null where head has none."""
    pairs = gate.pair_rows(package_metrics(spark, d), package_metrics(spark, d, base=True), [*_COUNTS, "duplication_pct"])
    return R.deltas_json(pairs, _COUNTS, ["duplication_pct"])


_one = lambda c: f"printf('%.1f', CAST({c} AS DOUBLE))"
_CELLS = {
    "PATH": "package", "PASSES": _one("passes"), "TIER": "tier", "DAYS": f"CASE WHEN {_one('days_low')} = {_one('days_high')} THEN {_one('days_low')} ELSE {_one('days_low')} || '-' || {_one('days_high')} END",
    "FAN_IN": "CAST(fan_in AS VARCHAR)", "TOKENS": "CAST(tokens_est AS VARCHAR)", "DUP%": _one("duplication_pct"), "CHURN": "coalesce(CAST(churn_commits AS VARCHAR), '-')", "ROLE": "coalesce(nullif(role, ''), '-')",
}
_W = [f"CAST((SELECT max(length(c{i})) FROM cl) AS INTEGER)" for i in range(len(R.COLUMNS))]
_PADDED = " || ".join((f"lpad(c{i}, {_W[i]}, ' ') || '  '" if c in R.RIGHT else f"rpad(c{i}, {_W[i]} + 2, ' ')") if i < len(R.COLUMNS) - 1 else f"c{i}" for i, c in enumerate(R.COLUMNS))


@query(f"{G._RANK}, rr AS (SELECT rk.*, m.role, row_number() OVER (ORDER BY passes DESC, rk.package) AS place FROM rk JOIN m ON m.package = rk.package), cl AS (SELECT 0 AS place, {', '.join(f'CAST({c!r} AS VARCHAR) AS c{i}' for i, c in enumerate(R.COLUMNS))} UNION ALL SELECT place, {', '.join(f'{_CELLS[c]} AS c{i}' for i, c in enumerate(R.COLUMNS))} FROM rr) SELECT place, {_PADDED} AS line FROM cl")
def k4_rank_table(spark, d):
    """K4: the whole ranking as a table, numbers right-aligned."""
    rows = G._ranked(spark, d).join(package_metrics(spark, d).select("package", "role"), "package")
    return R.ranking_table(rows, rank.sort_order("passes"))


@query("SELECT o_orderkey, CASE WHEN v < 0 THEN '-' ELSE '' END || CASE WHEN w >= 1000000 THEN CAST(w // 1000000 AS VARCHAR) || ',' || lpad(CAST(w // 1000 % 1000 AS VARCHAR), 3, '0') || ',' || lpad(CAST(w % 1000 AS VARCHAR), 3, '0') WHEN w >= 1000 THEN CAST(w // 1000 AS VARCHAR) || ',' || lpad(CAST(w % 1000 AS VARCHAR), 3, '0') ELSE CAST(w AS VARCHAR) END || CASE WHEN f = 0 THEN '' WHEN f % 10 = 0 THEN '.' || (f // 10) ELSE '.' || lpad(CAST(f AS VARCHAR), 2, '0') END AS text FROM (SELECT o_orderkey, v, CAST(floor(abs(v)) AS BIGINT) AS w, CAST(round(abs(v) * 100) AS BIGINT) % 100 AS f FROM (SELECT o_orderkey, CAST(CAST(floor(o_totalprice * 100) AS BIGINT) * CASE WHEN o_orderkey % 3 = 0 THEN -10 ELSE 1 END AS DOUBLE) / 100 AS v FROM orders))")
def x11_grouped(spark, d):
    """X11: numbers with their whole part in groups of three digits."""
    v = F.expr("CAST(CAST(floor(o_totalprice * 100) AS BIGINT) * CASE WHEN o_orderkey % 3 = 0 THEN -10 ELSE 1 END AS DOUBLE) / 100")
    return table(spark, d, "orders").select("o_orderkey", R.grouped(v).alias("text"))


@query("SELECT count(*) AS commits, count(*) FILTER (o_orderstatus <> 'P') AS loaded, count(*) FILTER (o_orderstatus = 'O') AS passed, count(*) FILTER (o_orderstatus = 'F') AS failed, CAST(sum(o_custkey) AS BIGINT) AS wall_ms FROM orders")
def k7_run_summary(spark, d):
    """K7: one row about a whole run."""
    return R.run_summary(table(spark, d, "orders").selectExpr("o_orderstatus <> 'P' AS loaded", "o_orderstatus = 'O' AS passed", "o_custkey AS wall_ms"))


_ROWS = ["p_partkey AS package", "p_size AS sloc", "p_partkey % 45 AS largest_file_sloc", "p_size * 10 AS tokens_est", "p_size * 10 + p_partkey % 4 - 1 AS tokens_est_with_tests", "CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_size - 5 END AS documented_exports", "p_partkey % 40 AS exported_symbols", "CAST(p_size * 3 - 10 AS DOUBLE) AS coverage_pct", "p_size % 9 - 1 AS internal_imports", "CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_size % 6 END AS internal_imports_descendants", "p_partkey % 5 AS internal_imports_private", "p_partkey % 3 AS generated_files", "p_size % 2 AS tokens_est_generated"]
_TESTS = [("internal_imports < 0", "internal_imports is negative"), ("coverage_pct < 0 OR coverage_pct > 100", "coverage_pct outside [0, 100]"), ("tokens_est_generated > 0 AND generated_files = 0", "tokens_est_generated with generated_files 0"), ("internal_imports_private > coalesce(internal_imports_descendants, internal_imports)", "internal_imports_private exceeds what it is part of")]
_TESTS += [(f"{a} > {b}", f"{a} exceeds {b}") for a, b in (("largest_file_sloc", "sloc"), ("tokens_est", "tokens_est_with_tests"), ("documented_exports", "exported_symbols"), ("internal_imports_descendants", "internal_imports"))]


@query(f"WITH r AS (SELECT {', '.join(_ROWS)} FROM part) " + " UNION ALL ".join(f"SELECT package, '{m}' AS problem FROM r WHERE {t}" for t, m in _TESTS))
def p4_validation(spark, d):
    """Metrics out of range and broken cross-field rules, every one."""
    return packages.validation_errors(table(spark, d, "part").selectExpr(*_ROWS), ["coverage_pct"], ["internal_imports", "sloc"])
