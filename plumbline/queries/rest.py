"""Schemas, sweep settings, pools, stores of JSON lines, narratives."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import schema as C
from plumbline.operators import aggregates as A
from plumbline.operators import rank
from plumbline.plans import sweep
from plumbline.plans.rules import SHIPPED, rules_sql
from plumbline.queries import rank_gate as G
from plumbline.queries.registry import registry
from plumbline.sinks import report as R
from plumbline.sources import readers, store
from plumbline.sources.host import table
from plumbline.sources.shared import shared_path

QUERIES, SQL, query = registry()


@query("SELECT * FROM (VALUES " + ", ".join(f"({i}, '{m}', '{t}', {m in C.SOMETIMES})" for i, (m, t) in enumerate(C.METRICS.items())) + ") t(place, metric, type, nullable)")
def p2_metric_names(spark, d):
    """The metrics in order, with types and whether they may be unknown, from the row schema itself."""
    fields = [f for f in C.row_schema().fields if f.name in C.METRICS]
    return spark.createDataFrame([(i, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(fields)], "place int, metric string, type string, nullable boolean")


def _values(items):
    return ", ".join(f"({float(v)})" for v in items)


_GRID = f"""WITH r AS {rules_sql()},
s AS (SELECT ord, metric, 'max' AS lim, floor(max * f + 0.5) AS value FROM r, (VALUES {_values(sweep.MAX_SHARES)}) v(f) WHERE max IS NOT NULL UNION SELECT ord, metric, 'max', max FROM r WHERE max IS NOT NULL
UNION SELECT ord, metric, 'max_delta', f FROM r, (VALUES {_values(sweep.DELTAS)}) v(f) WHERE max_delta IS NOT NULL UNION SELECT ord, metric, 'max_delta', max_delta FROM r WHERE max_delta IS NOT NULL UNION SELECT ord, metric, 'max_delta', 2 * max_delta FROM r WHERE max_delta IS NOT NULL
UNION SELECT ord, metric, 'over_max_delta', f FROM r, (VALUES {_values(sweep.OVER_DELTAS)}) v(f) WHERE max IS NOT NULL AND (kind = 'capacity' OR metric = '{sweep.CHANGED}') AND f >= max / 1000 AND f <= max / 2 UNION SELECT ord, metric, 'over_max_delta', x FROM (SELECT ord, metric, unnest([0.0, coalesce(over_max_delta, 0)]) AS x FROM r WHERE max IS NOT NULL AND (kind = 'capacity' OR metric = '{sweep.CHANGED}'))
UNION SELECT ord, metric, 'when', f FROM r, (VALUES {_values(sweep.GUARDS)}) v(f) WHERE when_metric IS NOT NULL UNION SELECT ord, metric, 'when', when_value FROM r WHERE when_metric IS NOT NULL
UNION SELECT ord, metric, 'floor', f FROM r, (VALUES {_values(sweep.FLOORS)}) v(f) WHERE floor IS NOT NULL AND (max IS NULL OR f < max) UNION SELECT ord, metric, 'floor', floor FROM r WHERE floor IS NOT NULL
UNION SELECT ord, metric, 'max', NULL FROM r WHERE max IS NOT NULL AND kind = 'density' AND max_delta IS NOT NULL UNION SELECT ord, metric, 'max_delta', NULL FROM r WHERE max_delta IS NOT NULL AND max IS NOT NULL UNION SELECT ord, metric, 'when', NULL FROM r WHERE when_metric IS NOT NULL UNION SELECT ord, metric, 'floor', NULL FROM r WHERE floor IS NOT NULL)
SELECT s.ord AS rule, s.metric, lim AS "limit", value, coalesce(value = CASE lim WHEN 'max' THEN r.max WHEN 'max_delta' THEN r.max_delta WHEN 'over_max_delta' THEN coalesce(r.over_max_delta, 0) WHEN 'when' THEN r.when_value ELSE r.floor END, false) AS shipped FROM s JOIN r USING (ord)"""


@query(_GRID)
def r17_settings(spark, d):
    """Every setting that a sweep of the shipped rules tries."""
    return sweep.settings_table(spark, SHIPPED)


_POOLED = ["CASE WHEN l_suppkey % 4 = 0 THEN 'std' ELSE 'm' || (l_suppkey % 3) END AS module", "CASE WHEN l_partkey % 25 = 0 THEN '<module>' ELSE 'p' || l_partkey END AS package"]


@query(f"WITH r AS (SELECT {', '.join(_POOLED)} FROM lineitem) SELECT 'internal_imports' AS metric, count(*) FILTER (package <> '<module>' AND module <> 'std') AS n FROM r UNION ALL SELECT 'dup_blocks_cross_pkg', count(*) FILTER (package = '<module>') FROM r UNION ALL SELECT 'sloc', count(*) FILTER (package <> '<module>') FROM r UNION ALL SELECT 'changed_func_cognitive_max', count(*) FILTER (package <> '<module>') FROM r")
def p19_pools(spark, d):
    """How many rows each metric is fitted from."""
    rows = table(spark, d, "lineitem").selectExpr(*_POOLED)
    metrics = ("internal_imports", "dup_blocks_cross_pkg", "sloc", "changed_func_cognitive_max")
    counts = rows.agg(*[F.count_if(A.in_pool(A.pool_of(m), F.col("module"), F.col("package"))).alias(m) for m in metrics])
    return counts.select(F.explode(F.create_map(*[x for m in metrics for x in (F.lit(m), F.col(m))])).alias("metric", "n"))


@query("SELECT DISTINCT source AS module FROM documents WHERE source IS NOT NULL")
def r25_modules(spark, d):
    """The modules of a corpus of one language."""
    return A.one_language(table(spark, d, "documents").where("source is not null").select(F.col("source").alias("module"), F.lit("go").alias("language")))


@query("SELECT p_brand AS reason, count(*) AS n, min(p_partkey) AS first FROM part GROUP BY p_brand")
def r32_groups(spark, d):
    """What a change left out, by reason, the largest group first."""
    return A.grouped_reasons(table(spark, d, "part").withColumnRenamed("p_brand", "reason"), "reason", "p_partkey")


_SPAN = ["l_suppkey AS package", "CAST(l_quantity AS BIGINT) AS tokens", "l_partkey AS block", "l_orderkey AS file", "l_linenumber * 10 AS first_line", "l_linenumber * 10 + CAST(l_quantity AS BIGINT) AS last_line"]


@query(f"SELECT package, place, file, first_line, last_line, last_line - first_line + 1 AS lines FROM (SELECT *, row_number() OVER (PARTITION BY package ORDER BY tokens DESC, block, file, first_line) AS place FROM (SELECT {', '.join(_SPAN)} FROM lineitem)) WHERE place <= 2")
def o8_chunks(spark, d):
    """Two places of each package's longest block."""
    return A.first_chunks(table(spark, d, "lineitem").selectExpr(*_SPAN))


@query(f"{G._RANK} SELECT count(*) AS packages, CAST(sum(CAST(round(days * 10) AS BIGINT)) AS BIGINT) / 10 AS days, count(*) FILTER (band = 'split') AS split, count(*) FILTER (band = 'watch') AS watch, count(*) FILTER (band = 'fine') AS fine, CAST(floor(sum(CASE WHEN band = 'split' THEN tokens_est ELSE 0 END) * 1000 / sum(tokens_est)) AS BIGINT) AS split_permille FROM bd")
def k12_story(spark, d):
    """A module's narrative as figures."""
    return A.module_story(rank.bands(G._ranked(spark, d), G._limits(spark, d)))


@query("SELECT page_id % 50 AS root, count(DISTINCT CASE page_id % 6 WHEN 0 THEN 'go' WHEN 1 THEN 'typescript' END) AS n, CASE WHEN count(DISTINCT CASE page_id % 6 WHEN 0 THEN 'go' WHEN 1 THEN 'typescript' END) = 1 THEN max(CASE page_id % 6 WHEN 0 THEN 'go' WHEN 1 THEN 'typescript' END) END AS language FROM pages GROUP BY page_id % 50")
def s2_languages(spark, d):
    """The language of each root: the only one whose marker is there."""
    files = table(spark, d, "pages").selectExpr("page_id % 50 AS root", "'x/' || page_id || CASE page_id % 6 WHEN 0 THEN '/go.mod' WHEN 1 THEN '/package.json' ELSE '/a.txt' END AS path")
    return readers.languages(files, {"go": "go.mod", "typescript": "package.json"})


@query("SELECT o_orderkey AS commit, o_custkey AS seq FROM orders")
def s18_json_lines(spark, d):
    """Rows appended to a store of JSON lines and read back."""
    import uuid

    path = f"{shared_path(spark)}/plumbline-lines-{uuid.uuid4().hex}"
    rows = table(spark, d, "orders").selectExpr("o_orderkey AS commit", "o_custkey AS seq")
    store.append_lines(rows.where("commit % 2 = 0"), path)
    store.append_lines(rows.where("commit % 2 = 1"), path)
    return store.read_lines(spark, path, "commit bigint, seq bigint", "commit")


_TS = "CASE page_id % 11 WHEN 0 THEN 'src/a' || page_id % 7 || '/x.ts' WHEN 1 THEN 'src/a' || page_id % 7 || '/x.d.ts' WHEN 2 THEN 'src/a' || page_id % 7 || '/__tests__/deep/y.tsx' WHEN 3 THEN 'node_modules/p/z.ts' WHEN 4 THEN 'pk' || page_id % 3 || '/lib/w.mts' WHEN 5 THEN 'pk1/package.json' WHEN 6 THEN '.hid/v.ts' WHEN 7 THEN 'main' || page_id || '.ts' WHEN 8 THEN 'src/b/u.spec.cts' WHEN 9 THEN 'README.md' ELSE 'src/dist/t.ts' END"


@query(f"WITH f AS (SELECT DISTINCT {_TS} AS path FROM pages), s AS (SELECT path, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END AS dir FROM f WHERE regexp_matches(path, '[.](ts|tsx|mts|cts)$') AND NOT regexp_matches(path, '[.]d[.](ts|mts|cts)$')) SELECT path, CASE WHEN regexp_replace(dir, '(^|/)__tests__(/.*)?$', '') = '' THEN '.' ELSE regexp_replace(dir, '(^|/)__tests__(/.*)?$', '') END AS package, regexp_matches(path, '[.](test|spec)[.](ts|tsx|mts|cts)$') OR regexp_matches(dir, '(^|/)__tests__(/|$)') AS is_test FROM s WHERE NOT regexp_matches(dir, '(^|/)(node_modules|dist|build|[.][^/]*)(/|$)') AND NOT (starts_with(path, 'pk1/') AND 'pk1/package.json' IN (SELECT path FROM f))")
def s8_typescript_files(spark, d):
    """Which files belong to a module, and to which of its packages."""
    return readers.typescript_files(table(spark, d, "pages").select(F.expr(_TS).alias("path")))


_GO = "'x := pk' || p_partkey % 5 || '.New() // pk9.Gone()' || chr(10) || 's := \"pk8.Quoted\"; pk' || p_size % 3 || '.Run(a.b, z.Do)' || chr(10)"


@query(f"SELECT p_partkey, array_to_string(list_sort(list_distinct(['pk' || p_partkey % 5 || '.New', 'pk' || p_size % 3 || '.Run', 'z.Do'])), ',') AS names FROM part")
def h15_selectors(spark, d):
    """What tests of packages that don't load refer to, by name; comments and strings don't count."""
    return table(spark, d, "part").select("p_partkey", F.array_join(readers.selectors(F.expr(_GO)), ",").alias("names"))


@query("SELECT 1 AS place, '| source | docs | longest |' AS line UNION ALL SELECT 2, '| --- | ---: | ---: |' UNION ALL SELECT 2 + row_number() OVER (ORDER BY source NULLS FIRST), '| ' || coalesce(source, '') || ' | ' || count(*) || ' | ' || max(n_chars) || ' |' FROM documents GROUP BY source")
def k14_markdown(spark, d):
    """A result as a Markdown table."""
    rows = table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("docs"), F.max("n_chars").alias("longest"))
    return R.markdown_table(rows, ["source", "docs", "longest"], ["source"])


_FIT = "CASE WHEN l_quantity < 5 THEN -l_quantity WHEN l_quantity < 20 THEN l_quantity / 100 ELSE l_extendedprice / 7 END"


@query(f"SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, CASE WHEN fixed THEN 300.0 WHEN v < 0 THEN 0.0 WHEN v = 0 THEN 0.0 WHEN k < 0 THEN round(v * pow(10.0, -k)) / pow(10.0, -k) ELSE round(v / pow(10.0, k)) * pow(10.0, k) END AS emitted FROM (SELECT *, CASE WHEN v <> 0 THEN floor(log10(abs(v))) - 1 END AS k FROM (SELECT l_orderkey, l_linenumber, l_partkey, {_FIT} AS v, l_linenumber = 7 AS fixed FROM lineitem))")
def c13_emitted(spark, d):
    """Fitted parameters as a configuration takes them."""
    v = F.expr(_FIT)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", R.emitted(v, F.lit(0.0), F.lit(300.0), F.col("l_linenumber") == 7).alias("emitted")).distinct()


@query("SELECT l_suppkey AS package, count(*) AS n FROM lineitem GROUP BY ALL")
def t4_cached(spark, d):
    """T4: a table kept under a key is built once."""
    import uuid

    root = f"{shared_path(spark)}/plumbline-cache-{uuid.uuid4().hex}"
    build = lambda more: lambda: table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("package")).agg((F.count("*") + more).alias("n"))
    store.cached(spark, root, "base", build(0))
    return store.cached(spark, root, "base", build(1))
