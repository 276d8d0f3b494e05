"""Readers, sinks and the stream, fed from lines made of the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from plumbline.sources import readers as R
from plumbline.sources import store
from plumbline.sources.host import metrics_sql, package_metrics, table
from plumbline.sources.shared import shared_path

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("SELECT 'c:/m/f' || CAST(l_suppkey AS VARCHAR) || '.go' AS file, l_partkey AS l0, CAST(l_linenumber AS BIGINT) AS c0, l_partkey + 3 AS l1, CAST(2 AS BIGINT) AS c1, CAST(l_linenumber AS BIGINT) AS stmts, CAST(l_quantity AS BIGINT) AS count FROM lineitem")
def s16_coverage_profile(spark, d):
    line = "concat('c:/m/f', l_suppkey, '.go:', l_partkey, '.', l_linenumber, ',', l_partkey + 3, '.2 ', l_linenumber, ' ', CAST(l_quantity AS BIGINT)) AS value"
    return R.coverage_profile(table(spark, d, "lineitem").selectExpr(line).union(spark.createDataFrame([("mode: set",)], "value string")))


@query("SELECT event_id, CASE event_type WHEN 'error' THEN 'block' ELSE 'pass' END AS event, 'p' || CAST(user_id AS VARCHAR) AS package FROM events WHERE event_id % 10 <> 3 AND event_type IN ('error', 'purchase')")
def s19_log_lines(spark, d):
    """Bad lines (cut off, or of another version) are set aside."""
    e = table(spark, d, "events").where("event_type IN ('error', 'purchase')")
    line = F.concat(F.lit('{"v": 1, "event": "'), F.when(F.col("event_type") == "error", "block").otherwise("pass"), F.lit('", "module": "m", "metric": "sloc", "package": "p'), F.col("user_id").cast("string"), F.lit('"}'))
    line = F.when(F.col("event_id") % 10 == 3, F.substring(line, 1, 40)).otherwise(line)
    return R.log_lines(e.select("event_id", line.alias("value")))[0].select("event_id", "event", "package")


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'R' WHEN 1 THEN 'D' WHEN 2 THEN 'A' ELSE 'M' END AS status, 'a/' || p_name AS old, CASE p_partkey % 4 WHEN 0 THEN 'b/' || p_name WHEN 1 THEN NULL ELSE 'a/' || p_name END AS new FROM part")
def s11_name_status(spark, d):
    z = "\u0000"
    path, to = F.concat(F.lit("a/"), "p_name"), F.concat(F.lit("b/"), "p_name")
    r = F.col("p_partkey") % 4
    text = F.when(r == 0, F.concat(F.lit("R100" + z), path, F.lit(z), to, F.lit(z))).otherwise(F.concat(F.when(r == 1, "D").when(r == 2, "A").otherwise("M"), F.lit(z), path, F.lit(z)))
    return R.name_status(table(spark, d, "part").select("p_partkey", text.alias("value"))).select("p_partkey", "status", "old", "new")


@query("SELECT o_orderkey AS seq, 'h' || CAST(o_orderkey AS VARCHAR) AS commit, 'user ' || CAST(o_custkey AS VARCHAR) AS author, 'f' || CAST(l_partkey AS VARCHAR) AS path FROM orders JOIN lineitem ON l_orderkey = o_orderkey")
def s10_commit_walk(spark, d):
    paths = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.concat_ws("\n", F.collect_list(F.concat(F.lit("f"), F.col("l_partkey").cast("string")))).alias("paths"))
    o = table(spark, d, "orders").join(paths, F.col("o_orderkey") == F.col("l_orderkey"))
    text = F.concat(F.lit("h"), F.col("o_orderkey").cast("string"), F.lit("\nUser "), F.col("o_custkey").cast("string"), F.lit(" \n"), "paths", F.lit("\n"))
    return R.commit_walk(o.select(F.col("o_orderkey").alias("seq"), text.alias("value"))).select("seq", "commit", "author", "path")


@query("SELECT url, dir, CASE WHEN starts_with(dir || '/', 'site/a/') THEN 'site/a' WHEN starts_with(dir || '/', 'site/') THEN 'site' END AS module FROM (SELECT url, CASE page_id % 3 WHEN 0 THEN 'site/a/x' || CAST(page_id AS VARCHAR) WHEN 1 THEN 'site/b' ELSE 'other/q' END AS dir FROM pages)")
def s4_nearest_module(spark, d):
    p = table(spark, d, "pages").selectExpr("url", "CASE page_id % 3 WHEN 0 THEN concat('site/a/x', page_id) WHEN 1 THEN 'site/b' ELSE 'other/q' END AS dir")
    return R.nearest_module(p, spark.createDataFrame([("site",), ("site/a",)], "module string")).select("url", "dir", "module")


@query("SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'marker' WHEN 1 THEN 'test' WHEN 2 THEN 'source' WHEN 3 THEN 'test' WHEN 4 THEN 'other' ELSE 'source' END AS kind FROM part")
def p13_classify(spark, d):
    p = "CASE p_partkey % 6 WHEN 0 THEN 'm/go.mod' WHEN 1 THEN 'm/a_test.go' WHEN 2 THEN 'm/a.go' WHEN 3 THEN 'm/__tests__/a.ts' WHEN 4 THEN 'm/a.d.ts' ELSE 'm/a.tsx' END AS path"
    return table(spark, d, "part").selectExpr("p_partkey", p).select("p_partkey", R.classify_path(F.col("path")).alias("kind"))


@query("SELECT doc_id, len(list_filter(string_split(regexp_replace(coalesce(text, ''), '//[^\\n]*', '', 'g'), chr(10)), lambda x: regexp_matches(x, '[^ \\t\\n\\f\\r\\x0b]'))) AS sloc FROM documents WHERE coalesce(text, '') NOT LIKE '%/*%'")
def a3_source_lines(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return docs.select("doc_id", R.source_lines(F.col("text")).alias("sloc"))


@query(f"SELECT package, 'sloc' AS metric, CAST(sloc AS DOUBLE) AS value FROM {metrics_sql()} UNION ALL SELECT package, 'fan_in', CAST(fan_in AS DOUBLE) FROM {metrics_sql()}")
def k5_baseline_round_trip(spark, d):
    """Packages written as a baseline file and read back."""
    root = f"{shared_path(spark)}/baseline-{uuid.uuid4().hex}"
    cells = F.map_from_arrays(F.array(F.lit("sloc"), F.lit("fan_in")), F.array(F.col("sloc").cast("double"), F.col("fan_in").cast("double")))
    rows = package_metrics(spark, d).select(F.struct(F.concat(F.lit("m/"), "package").alias("k"), cells.alias("v")).alias("e"), F.struct(F.concat(F.lit("m/"), "package").alias("k"), F.struct(F.col("package").alias("package_path")).alias("v")).alias("r"))
    # a baseline file is one document: a module's packages
    doc = rows.agg(F.map_from_entries(F.collect_list("e")).alias("packages"), F.map_from_entries(F.collect_list("r")).alias("package_rows")).withColumn("module_path", F.lit("m"))
    R.write_single(doc, root)
    return R.read_baseline(spark, root)


@query("SELECT l_orderkey AS commit, 'p' || CAST(l_suppkey AS VARCHAR) AS package FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def k6_replay_store(spark, d):
    """K6: batches recorded, one of them twice; rows without their commit's row don't count."""
    root = f"{shared_path(spark)}/store-{uuid.uuid4().hex}"
    p = table(spark, d, "lineitem").selectExpr("l_orderkey AS commit", "concat('p', l_suppkey) AS package")
    c = table(spark, d, "orders").where("o_orderstatus = 'F'").selectExpr("o_orderkey AS commit")
    for batch in (0, 1, 1):
        store.record(p.where(F.col("commit") % 2 == batch), c.where(F.col("commit") % 2 == batch), root, batch)
    return store.read(spark, root)[0]


@query("SELECT seq, kind, package FROM (SELECT o_orderkey AS seq, 1 AS kind, CAST(NULL AS VARCHAR) AS package FROM orders UNION ALL SELECT l_orderkey, 0, 'p' || CAST(l_suppkey AS VARCHAR) FROM lineitem)")
def k9_interleaved(spark, d):
    p = table(spark, d, "lineitem").selectExpr("l_orderkey AS seq", "concat('p', l_suppkey) AS package")
    c = table(spark, d, "orders").selectExpr("o_orderkey AS seq", "o_orderstatus AS status")
    return store.interleaved(p, c).select("seq", "kind", "package")


@query("WITH l AS (SELECT user_id, event_id % 3 AS metric, event_id AS ord, CASE event_type WHEN 'error' THEN 'block' ELSE 'pass' END AS event, value FROM events WHERE event_type IN ('error', 'purchase')), n AS (SELECT *, coalesce(sum(CASE event WHEN 'pass' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, metric ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS episode FROM l) SELECT user_id, metric, count(*) FILTER (event = 'block') AS blocks, min(ord) FILTER (event = 'block') AS blocked_at, arg_max(value, ord) FILTER (event = 'block') AS head, min(ord) FILTER (event = 'pass') AS resolved_at, arg_max(value, ord) FILTER (event = 'pass') AS passed FROM n GROUP BY user_id, metric, episode HAVING blocks > 0 AND resolved_at IS NOT NULL")
def t2_streamed_episodes(spark, d):
    """The block log as a stream with state, until all that is there has been read."""
    from plumbline.streaming.episodes import resolved

    root = f"{shared_path(spark)}/episodes-{uuid.uuid4().hex}"
    schema = table(spark, d, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    lines = stream.where("event_type IN ('error', 'purchase')").selectExpr("user_id", "event_id % 3 AS metric", "event_id AS ord", "CASE event_type WHEN 'error' THEN 'block' ELSE 'pass' END AS event", "value")
    run = resolved(lines).writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(f"{root}/out")


