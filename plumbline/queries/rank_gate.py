"""Ranking and the gate over supplier packages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions import scalar as S
from plumbline.operators import gate, rank
from plumbline.plans.rules import SHIPPED, TYPESCRIPT, merge_rules, rules_sql, rules_table
from plumbline.sources.host import metrics_sql, package_metrics

P = S.RebuildParams()
RULE_METRICS = [m for m in dict.fromkeys(r.metric for r in SHIPPED) if m != "dup_blocks_cross_pkg"] + ["duplicated_lines"]
TODAY = "2024-06-30"
#: ord, package, metric, reason, expires
EXEMPTIONS = [
    (i, f"pkg{i % 50}", m, f"reason {i}", e)
    for i, (m, e) in enumerate([("dup_blocks", None), ("duplication_pct", None), ("sloc", "2024-06-30"), ("tokens_est", None), ("sloc", "2024-06-29"), ("max_nesting", "2025-01-01")] * 30)
]


def _exemptions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(EXEMPTIONS, "ord int, package string, metric string, reason string, expires string").withColumn("expires", F.col("expires").cast("date"))


EXEMPTIONS_SQL = "(SELECT * FROM (VALUES " + ", ".join(f"({o}, '{p}', '{m}', '{r}', CAST({'NULL' if e is None else repr(e)} AS DATE))" for o, p, m, r, e in EXEMPTIONS) + ") t(ord, package, metric, reason, expires))"


def _estimated(spark, d) -> DataFrame:
    return rank.estimates(package_metrics(spark, d), P)


def _limits(spark, d) -> DataFrame:
    return gate.ceilings(package_metrics(spark, d), rules_table(spark), RULE_METRICS)


def _ranked(spark, d) -> DataFrame:
    return rank.rank_rows(gate.with_headroom(_estimated(spark, d), SHIPPED))


def rank_flagship(spark: SparkSession, d: str) -> DataFrame:
    """The ranking by passes, first 100."""
    return rank.top(_ranked(spark, d), "passes", 100)


def x4_rebuild_terms(spark, d):
    return _estimated(spark, d).select("package", *[S.round_to(f"t_{t}", 6).alias(t) for t in S.TERMS], S.round_to("rebuild_tokens", 6).alias("rebuild_tokens"), S.round_to("agent_passes", 9).alias("agent_passes"), "tier")


def x5_human_days(spark, d):
    return _estimated(spark, d).select("package", S.round_to("days_81", 6).alias("days_81"), S.round_to("days_ii", 6).alias("days_ii"), S.round_to("days_low", 6).alias("days_low"), S.round_to("days_high", 6).alias("days_high"))


def x6_understanding(spark, d):
    return package_metrics(spark, d).select("package", S.understanding().alias("understanding"), S.round_to(S.effective_kloc(P), 9).alias("kloc"), S.complexity_rating().alias("complexity"))


def x8_levels(spark, d):
    rows = _ranked(spark, d)
    banded = rank.bands(rows, _limits(spark, d))
    return banded.select("package", "band", "over", "hotspot", F.when(F.col("passes") <= P.one_pass_max, 0).when(F.col("passes") <= P.few_passes_max, 1).otherwise(2).alias("sittings"))


def o1_sort_keys(spark, d):
    """The package's place under each of the eight keys."""
    places = [f"by_{k}" for k in rank.SORT_KEYS]
    return rank.with_ranks(_ranked(spark, d)).select("package", *places)


def o2_hotter(spark, d):
    return rank.hotter(_ranked(spark, d)).select("package", "hotspot", "passes", "days_low")


def o3_drivers(spark, d):
    return rank.drivers(_estimated(spark, d)).select("package", F.array_join("drivers", ",").alias("drivers"))


def a21_driver_shares(spark, d):
    total = F.greatest(F.lit(1.0), F.col("rebuild_tokens"))
    return _estimated(spark, d).select("package", *[S.round_to(F.col(f"t_{t}") * 100 / total, 6).alias(t) for t in S.TERMS])


def a31_module_totals(spark, d):
    return rank.module_totals(rank.bands(_ranked(spark, d), _limits(spark, d)))


def g11_ceilings(spark, d):
    return _limits(spark, d).select("package", "metric", "value", "max", "remaining", "used")


def g12_headroom(spark, d):
    return gate.headroom(_limits(spark, d))


def r33_meters(spark, d):
    """Ceilings that are used by 0.8 or more."""
    return _limits(spark, d).where("used >= 0.8").select("package", "metric", "used")


def _pairs(spark, d):
    return gate.pair_rows(package_metrics(spark, d), package_metrics(spark, d, base=True), RULE_METRICS)


def _findings(spark, d, rules=SHIPPED):
    return gate.evaluate(_pairs(spark, d), rules_table(spark, rules), RULE_METRICS)


FOUND = ["package", "ord", "part", "metric", "severity", "warning", "base", "head", "has_base", "label"]


def g1_findings(spark, d):
    """Every finding before merging."""
    return _findings(spark, d).select(*FOUND)


def j25_language_rules(spark, d):
    """The same under the TypeScript rules, which replace the shipped ones in place."""
    return _findings(spark, d, merge_rules(SHIPPED, TYPESCRIPT)).select(*FOUND)


def g2_notes(spark, d):
    return gate.notes(_pairs(spark, d), rules_table(spark), RULE_METRICS)


def g9_merged(spark, d):
    out = gate.merge_findings(_findings(spark, d))
    return out.select("package", "ord", "metric", "kind", "severity", "label", F.array_join("also", ",").alias("also"))


def j17_exempted(spark, d):
    out = gate.exempt(gate.merge_findings(_findings(spark, d)), _exemptions(spark), TODAY)
    return out.where("reason is not null").select("package", "ord", "metric", "reason")


def g1_verdicts(spark, d):
    out = gate.exempt(gate.merge_findings(_findings(spark, d)), _exemptions(spark), TODAY)
    return gate.verdicts(out, package_metrics(spark, d))


def g17_notices(spark, d):
    return gate.stale_exemptions(_exemptions(spark), gate.merge_findings(_findings(spark, d)), TODAY)


def p1_value_by_name(spark, d):
    return gate.to_long(package_metrics(spark, d), ["sloc", "has_tests", "coverage_pct", "churn_commits"], ["package"]).withColumn("ok", F.col("value").isNotNull())


def p3_deltas(spark, d):
    pairs = _pairs(spark, d)
    return pairs.select("package", *[S.delta(f"h_{m}", f"b_{m}").cast("double").alias(m) for m in ("sloc", "dup_blocks", "duplication_pct", "duplicated_lines", "changed_func_cognitive_max")])


def p10_coverage_source(spark, d):
    """P10: a rule that reads coverage judges the covered figure where head has it, and the baseline if there is one."""
    pairs = gate.pair_rows(package_metrics(spark, d), package_metrics(spark, d, base=True), ["untested_exports", "coverage_pct"])
    h, b = (F.when(F.col(f"{k}_coverage_pct").isNotNull(), F.floor(F.col(f"{k}_untested_exports") / 2)) for k in "hb")
    value, base = gate.covered_values(F.col("h_untested_exports"), F.col("b_untested_exports"), h, b, F.col("has_row"))
    return pairs.select("package", value.cast("bigint").alias("value"), base.cast("bigint").alias("base"))


def x3_coupling(spark, d):
    r = package_metrics(spark, d)
    i, a = S.instability(F.col("internal_imports"), F.col("fan_in")), S.abstractness(F.col("abstract_types"), F.col("types"))
    return r.select("package", S.round_to(i, 2).alias("instability"), S.round_to(a, 2).alias("abstractness"), S.round_to(S.main_sequence_distance(a, i), 2).alias("distance"))


def x1_rounding(spark, d):
    rows = spark.read.parquet(f"{d}/part.parquet")
    v = F.col("p_retailprice") * F.col("p_size") / 7
    return rows.select("p_partkey", S.round_to(v, 1).alias("one"), S.round_to(v, 2).alias("two"), S.round_to(v, 3).alias("three"), S.round_to(-v, 1).alias("negative"))


QUERIES = {f.__name__: f for f in (rank_flagship, x4_rebuild_terms, x5_human_days, x6_understanding, x8_levels, o1_sort_keys, o2_hotter, o3_drivers, a21_driver_shares, a31_module_totals, g11_ceilings, g12_headroom, r33_meters, g1_findings, j25_language_rules, g2_notes, g9_merged, j17_exempted, g1_verdicts, g17_notices, p1_value_by_name, p3_deltas, p10_coverage_source, x3_coupling, x1_rounding)}


def _num(v: str) -> str:
    return f"(CASE WHEN {v} = floor({v}) THEN CAST(CAST({v} AS BIGINT) AS VARCHAR) ELSE CAST({v} AS VARCHAR) END)"


def _r(v: str, k: int) -> str:
    return f"(round(({v}) * 1e{k}) / 1e{k})"


def _sub(v: str, cuts) -> str:
    return "(CASE " + " ".join(f"WHEN {v} <= {c} THEN {4 - i}" for i, c in enumerate(cuts)) + " ELSE 0 END)"


_M = (0.05, 0.15, 0.35, 0.6)
_EST = f"""m AS (SELECT * FROM {metrics_sql()}),
s AS (SELECT *,
  CAST(50 - 10 * floor((least({_sub('cognitive_p90', (4, 10, 20, 40))}, {_sub('dup_blocks', (0, 2, 5, 10))})
    + {_sub('least(greatest(CAST(untested_exports AS DOUBLE) / greatest(exported_symbols, 1), 0.0), 1.0)', _M)}
    + (CASE WHEN documented_exports IS NULL THEN 2 ELSE {_sub('least(greatest(CAST(exported_symbols - documented_exports AS DOUBLE) / greatest(exported_symbols, 1), 0.0), 1.0)', _M)} END)) / 3.0) AS DOUBLE) AS understanding,
  CASE WHEN func_count = 0 THEN 2 WHEN cognitive_p90 <= 1 THEN 0 WHEN cognitive_p90 <= 4 THEN 1 WHEN cognitive_p90 <= 10 THEN 2 WHEN cognitive_p90 <= 20 THEN 3 WHEN cognitive_p90 <= 40 THEN 4 ELSE 5 END AS complexity FROM m),
t AS (SELECT *, tokens_est * (1 - duplication_pct / 100) AS volume, CAST(greatest(tokens_est_with_tests - tokens_est, 0) AS DOUBLE) AS spec, exported_symbols * 0.0 AS contract,
  CASE WHEN coverage_pct IS NULL THEN untested_exports * 300.0 ELSE untested_exports * 300.0 * (1 - least(greatest(coverage_pct, 0), 100) / 100) END AS unspecified,
  (globals + init_funcs) * 0.0 AS hidden_state,
  sloc * (1 - duplication_pct / 100) / 1000 * (1 + 0.02 * understanding) AS kloc FROM s),
u AS (SELECT *, volume + spec + contract + unspecified + hidden_state AS rebuild_tokens, (volume + spec + contract + unspecified + hidden_state) / 37500.0 AS agent_passes,
  2.4 * pow(kloc, 1.05) * 19 AS days_81,
  {P.coefficient!r} * pow(kloc, {P.scale_exponent!r}) * [0.73, 0.87, 1.0, 1.17, 1.34, 1.74][complexity + 1] * 19 AS days_ii FROM t),
e AS (SELECT *, CASE WHEN agent_passes <= 1 THEN 'ONE_PASS' WHEN agent_passes <= 3 THEN 'FEW_PASSES' ELSE 'PARTITION' END AS tier, least(days_81, days_ii) AS days_low, greatest(days_81, days_ii) AS days_high FROM u)"""


def _long(rel: str, cols: list[str], keys: str) -> str:
    return " UNION ALL ".join(f"SELECT {keys}, '{m}' AS metric, CAST({m} AS DOUBLE) AS value FROM {rel}" for m in cols)


_ROLE_OK = "(len(roles) = 0 OR list_contains(roles, coalesce(nullif(role, ''), 'library')))"
_LIM = f"""l AS ({_long('m', RULE_METRICS, 'package, role')}),
lim AS (SELECT package, ord, metric, value, max, {_r('max - value', 3)} AS remaining, {_r('value / max', 3)} AS used FROM l JOIN {rules_sql()} r USING (metric) WHERE kind = 'capacity' AND max > 0 AND value IS NOT NULL AND {_ROLE_OK}),
hr AS (SELECT package, metric, remaining, used FROM (SELECT *, row_number() OVER (PARTITION BY package ORDER BY used DESC, ord) AS rn FROM lim) WHERE rn = 1)"""
_RANK = f"""WITH {_EST}, {_LIM},
rk0 AS (SELECT e.package, {_r('agent_passes', 1)} AS passes, {_r('days_ii', 1)} AS days, {_r('days_low', 1)} AS days_low, {_r('days_high', 1)} AS days_high, tier, fan_in, tokens_est, duplication_pct, churn_commits, hr.used AS headroom_used FROM e LEFT JOIN hr ON hr.package = e.package),
rk AS (SELECT *, CASE WHEN churn_commits IS NULL THEN 0.0 ELSE {_r('churn_commits * passes', 1)} END AS hotspot FROM rk0),
bd AS (SELECT rk.*, coalesce(o.n, 0) AS over, CASE WHEN tier = 'PARTITION' OR coalesce(o.n, 0) >= 2 THEN 'split' WHEN coalesce(o.n, 0) = 1 OR tier = 'FEW_PASSES' OR duplication_pct >= 25 THEN 'watch' ELSE 'fine' END AS band
  FROM rk LEFT JOIN (SELECT package, count(*) AS n FROM lim WHERE value > max GROUP BY package) o ON o.package = rk.package)"""


def _gate(rules: str) -> str:
    value = " UNION ALL ".join(f"SELECT h.package, h.role, b.package IS NOT NULL AS has_row, h.sloc AS hs, b.sloc AS bs, h.duplicated_lines AS hd, b.duplicated_lines AS bd, h.changed_func_cognitive_max AS hc, b.cognitive_p90 AS bc, '{m}' AS metric, CAST(h.{m} AS DOUBLE) AS h, CAST(b.{m} AS DOUBLE) AS b0 FROM hm h LEFT JOIN bm b ON b.package = h.package" for m in RULE_METRICS)
    return f"""WITH hm AS (SELECT * FROM {metrics_sql()}), bm AS (SELECT * FROM {metrics_sql(True)}),
v AS ({value}),
x AS (SELECT *, has_row AND b0 IS NOT NULL AS has_base, CASE WHEN has_row AND b0 IS NOT NULL THEN b0 ELSE 0 END AS b, coalesce(over_max_delta, 0) AS allowed,
  (NOT has_row OR CASE metric WHEN 'duplication_pct' THEN coalesce(hd > bd, TRUE) WHEN 'cognitive_p90' THEN coalesce(hc > bc, TRUE) ELSE TRUE END) AS rose
  FROM v JOIN {rules} r USING (metric) WHERE h IS NOT NULL AND {_ROLE_OK}),
dens AS (SELECT * FROM x WHERE kind = 'density' AND rose AND (floor IS NULL OR h > floor + 1e-9)),
cap AS (SELECT *, CASE WHEN h > max + 1e-9 THEN CASE WHEN NOT has_base OR b < max - 1e-9 THEN 'break' WHEN h <= b + 1e-9 THEN 'warn' WHEN allowed <= 0 THEN 'break' WHEN h - b <= allowed + 1e-9 THEN 'warn' ELSE 'break' END WHEN h < warn_at * max - 1e-9 THEN 'none' ELSE 'warn' END AS res,
  h > max + 1e-9 AND has_base AND b >= max - 1e-9 AND h > b + 1e-9 AND allowed > 0 AS beyond FROM x WHERE kind = 'capacity' AND max > 0),
f AS (
  SELECT package, ord, 0 AS part, metric, severity, FALSE AS warning, b AS base, h AS head, has_base, 'max_delta +' || {_num('max_delta')} AS label FROM dens WHERE max_delta IS NOT NULL AND (has_row OR ratchet) AND NOT (has_row AND b0 IS NULL) AND h - b > max_delta + 1e-9
  UNION ALL SELECT package, ord, 1, metric, severity, FALSE, b, h, has_base, 'max ' || {_num('max')} FROM dens WHERE max IS NOT NULL AND h > max + 1e-9 AND (NOT has_base OR (h > b + 1e-9 AND NOT (max_delta IS NOT NULL AND b >= max - 1e-9)))
  UNION ALL SELECT package, ord, CASE res WHEN 'break' THEN 2 ELSE 3 END, metric, severity, res = 'warn', b, h, has_base, CASE WHEN beyond THEN 'over max by ' || {_num('(h - max)')} || ', allowed ' || {_num('allowed')} ELSE 'max ' || {_num('max')} END FROM cap WHERE res <> 'none'
  UNION ALL SELECT package, ord, 4, metric, severity, FALSE, b, h, has_base, 'require ' || CASE WHEN require THEN 'true' ELSE 'false' END FROM x WHERE kind = 'requirement' AND (when_metric IS NULL OR hs > when_value) AND (h <> 0) <> require AND (NOT has_row OR hs > bs)
)"""


_COLS = ", ".join(FOUND)
_PLACE = {d: i for i, (_, d) in enumerate(gate.MERGES)}
_KEEPER = "CASE " + " ".join(f"WHEN metric = '{drop}' AND list_contains(here, '{keep}') AND NOT warning THEN '{keep}'" for keep, drop in gate.MERGES) + " END"
_MERGED = f"""{_gate(rules_sql())},
one AS (SELECT package, ord, metric, severity, warning, base, head, has_base, string_agg(label, ' and ' ORDER BY part) AS label, CASE WHEN NOT has_base THEN 1 ELSE CAST(sign(head - base) AS INT) END AS side FROM f GROUP BY ALL),
k AS (SELECT *, {_KEEPER} AS keeper FROM (SELECT *, list(metric) OVER (PARTITION BY package, severity, warning, side) AS here FROM one)),
gone AS (SELECT package, severity, side, keeper AS metric, string_agg(metric, ',' ORDER BY pl) AS also, string_agg(told, '; ' ORDER BY pl) AS told FROM (
  SELECT *, CASE metric {' '.join(f"WHEN '{d}' THEN {i}" for d, i in _PLACE.items())} END AS pl,
    metric || ' ' || CASE WHEN has_base THEN {_num(_r('base', 2))} || ' -> ' || {_num(_r('head', 2))} ELSE {_num(_r('head', 2))} END || ', ' || label AS told FROM k WHERE keeper IS NOT NULL) GROUP BY ALL),
mg AS (SELECT k.package, k.ord, k.metric, CASE WHEN NOT warning AND k.severity = 'fail' THEN 'violation' ELSE 'warning' END AS kind, k.severity, k.warning, k.base, k.head, k.has_base,
  label || coalesce('; ' || g.told, '') AS label, coalesce(g.also, '') AS also
  FROM k LEFT JOIN gone g ON g.package = k.package AND g.severity = k.severity AND g.side = k.side AND g.metric = k.metric AND NOT k.warning WHERE keeper IS NULL),
valid AS (SELECT * FROM {EXEMPTIONS_SQL} WHERE trim(reason) <> '' AND (expires IS NULL OR expires >= DATE '{TODAY}')),
ask AS (SELECT DISTINCT package, ord, metric, len(string_split(metric || CASE WHEN also = '' THEN '' ELSE ',' || also END, ',')) AS n, unnest(string_split(metric || CASE WHEN also = '' THEN '' ELSE ',' || also END, ',')) AS one FROM mg WHERE NOT warning),
ex AS (SELECT ask.package, ask.ord, ask.metric, arg_min(v.reason, v.ord) AS reason FROM ask JOIN valid v ON v.package = ask.package AND v.metric = ask.one GROUP BY ask.package, ask.ord, ask.metric, n HAVING count(DISTINCT one) = n)"""
_MGX = f"{_MERGED}, mx AS (SELECT mg.*, ex.reason FROM mg LEFT JOIN ex ON ex.package = mg.package AND ex.ord = mg.ord AND ex.metric = mg.metric AND NOT mg.warning)"

SQL = {
    "rank_flagship": f"{_RANK} SELECT * FROM rk ORDER BY passes DESC, package LIMIT 100",
    "x4_rebuild_terms": f"WITH {_EST} SELECT package, {', '.join(f'{_r(t, 6)} AS {t}' for t in S.TERMS)}, {_r('rebuild_tokens', 6)} AS rebuild_tokens, {_r('agent_passes', 9)} AS agent_passes, tier FROM e",
    "x5_human_days": f"WITH {_EST} SELECT package, {', '.join(f'{_r(t, 6)} AS {t}' for t in ('days_81', 'days_ii', 'days_low', 'days_high'))} FROM e",
    "x6_understanding": f"WITH {_EST} SELECT package, understanding, {_r('kloc', 9)} AS kloc, complexity FROM t",
    "x8_levels": f"{_RANK} SELECT package, band, over, hotspot, CASE WHEN passes <= 1 THEN 0 WHEN passes <= 3 THEN 1 ELSE 2 END AS sittings FROM bd",
    "o1_sort_keys": f"{_RANK} SELECT package, " + ", ".join(f"row_number() OVER (ORDER BY {o} DESC, package) AS by_{k}" for k, o in {"passes": "passes", "days": "days", "fan_in": "fan_in", "tokens": "tokens_est", "duplication": "duplication_pct", "churn": "coalesce(churn_commits, -1)", "hotspot": "hotspot DESC, days_low", "headroom": "coalesce(headroom_used, -1)"}.items()) + " FROM rk",
    "o2_hotter": f"{_RANK} SELECT package, hotspot, passes, days_low FROM rk ORDER BY hotspot DESC, passes DESC, days_low DESC, package",
    "o3_drivers": f"WITH {_EST} SELECT e.package, coalesce(d.drivers, '') AS drivers FROM e LEFT JOIN (SELECT package, string_agg(n, ',' ORDER BY rn) AS drivers FROM (SELECT *, row_number() OVER (PARTITION BY package ORDER BY v DESC, i) AS rn FROM (" + " UNION ALL ".join(f"SELECT package, {t} AS v, {i} AS i, '{t}' AS n FROM e" for i, t in enumerate(S.TERMS)) + ") WHERE v > 0) WHERE rn <= 2 GROUP BY package) d ON d.package = e.package",
    "a21_driver_shares": f"WITH {_EST} SELECT package, {', '.join(f'{_r(t + " * 100 / greatest(1.0, rebuild_tokens)", 6)} AS {t}' for t in S.TERMS)} FROM e",
    "a31_module_totals": f"{_RANK} SELECT round(CAST(sum(CAST(round(days * 10) AS BIGINT)) AS BIGINT) / 10) AS days, count(*) AS packages, count(*) FILTER (band = 'split') AS split, count(*) FILTER (band = 'watch') AS watch FROM bd",
    "g11_ceilings": f"WITH {_EST}, {_LIM} SELECT package, metric, value, max, remaining, used FROM lim",
    "g12_headroom": f"WITH {_EST}, {_LIM} SELECT * FROM hr",
    "r33_meters": f"WITH {_EST}, {_LIM} SELECT package, metric, used FROM lim WHERE used >= 0.8",
    "g1_findings": f"{_gate(rules_sql())} SELECT {_COLS} FROM f",
    "j25_language_rules": f"{_gate(rules_sql(merge_rules(SHIPPED, TYPESCRIPT)))} SELECT {_COLS} FROM f",
    "g2_notes": f"{_gate(rules_sql())} SELECT package, metric FROM x WHERE kind = 'density' AND max_delta IS NOT NULL AND has_row AND b0 IS NULL AND (floor IS NULL OR h > floor + 1e-9)",
    "g9_merged": f"{_MERGED} SELECT package, ord, metric, kind, severity, label, also FROM mg",
    "j17_exempted": f"{_MGX} SELECT package, ord, metric, reason FROM mx WHERE reason IS NOT NULL",
    "g1_verdicts": f"{_MGX} SELECT h.package, count(mx.ord) FILTER (kind = 'violation' AND reason IS NULL) AS violations, count(mx.ord) FILTER (kind = 'warning' AND reason IS NULL) AS warnings, count(reason) AS exempted, count(mx.ord) FILTER (kind = 'violation' AND reason IS NULL) = 0 AS passed FROM hm h LEFT JOIN mx ON mx.package = h.package GROUP BY h.package",
    "g17_notices": f"{_MGX} SELECT ord, package, metric, notice FROM (SELECT ord, package, metric, CASE WHEN expires < DATE '{TODAY}' THEN 'expired' WHEN (package, metric) NOT IN (SELECT package, one FROM ask) THEN 'stale' END AS notice FROM {EXEMPTIONS_SQL}) WHERE notice IS NOT NULL",
    "p1_value_by_name": f"SELECT package, metric, value, value IS NOT NULL AS ok FROM ({_long(metrics_sql(), ['sloc', 'has_tests', 'coverage_pct', 'churn_commits'], 'package')})",
    "p3_deltas": f"SELECT h.package, " + ", ".join(f"CAST(h.{m} - coalesce(b.{m}, 0) AS DOUBLE) AS {m}" for m in ("sloc", "dup_blocks", "duplication_pct", "duplicated_lines", "changed_func_cognitive_max")) + f" FROM {metrics_sql()} h LEFT JOIN {metrics_sql(True)} b ON b.package = h.package",
    "p10_coverage_source": f"SELECT h.package, CAST(CASE WHEN ok THEN floor(h.untested_exports / 2) ELSE h.untested_exports END AS BIGINT) AS value, CAST(CASE WHEN ok THEN floor(b.untested_exports / 2) ELSE b.untested_exports END AS BIGINT) AS base FROM (SELECT h.package, h.untested_exports, h.coverage_pct IS NOT NULL AND (b.package IS NULL OR b.coverage_pct IS NOT NULL) AS ok FROM {metrics_sql()} h LEFT JOIN {metrics_sql(True)} b ON b.package = h.package) h LEFT JOIN {metrics_sql(True)} b ON b.package = h.package",
    "x3_coupling": f"SELECT package, {_r('i', 2)} AS instability, {_r('a', 2)} AS abstractness, {_r('abs(a + i - 1)', 2)} AS distance FROM (SELECT package, CASE WHEN internal_imports + fan_in > 0 THEN CAST(internal_imports AS DOUBLE) / (internal_imports + fan_in) ELSE 0.0 END AS i, CASE WHEN types > 0 THEN CAST(abstract_types AS DOUBLE) / types ELSE 0.0 END AS a FROM {metrics_sql()})",
    "x1_rounding": f"SELECT p_partkey, {_r('v', 1)} AS one, {_r('v', 2)} AS two, {_r('v', 3)} AS three, {_r('-v', 1)} AS negative FROM (SELECT p_partkey, p_retailprice * p_size / 7 AS v FROM part)",
}
