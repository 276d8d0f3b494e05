"""Replay, labels, rates, sweeps and windows over events, orders, labels and documents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from plumbline.functions.scalar import round_to
from plumbline.operators import history as H
from plumbline.operators import matching as M
from plumbline.sources.host import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_LOG = "SELECT user_id, event_id % 3 AS metric, event_id AS ord, CASE event_type WHEN 'error' THEN 'block' ELSE 'pass' END AS event, value FROM events WHERE event_type IN ('error', 'purchase')"
_EP = f"""WITH l AS ({_LOG}), n AS (SELECT *, coalesce(sum(CASE event WHEN 'pass' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, metric ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS episode FROM l),
e AS (SELECT user_id, metric, CAST(episode AS BIGINT) AS episode, count(*) FILTER (event = 'block') AS blocks, min(ord) FILTER (event = 'block') AS blocked_at, arg_max(value, ord) FILTER (event = 'block') AS head, min(ord) FILTER (event = 'pass') AS resolved_at, arg_max(value, ord) FILTER (event = 'pass') AS passed FROM n GROUP BY ALL HAVING count(*) FILTER (event = 'block') > 0)"""


def _log(spark, d):
    e = table(spark, d, "events").where("event_type IN ('error', 'purchase')")
    return e.selectExpr("user_id", "event_id % 3 AS metric", "event_id AS ord", "CASE event_type WHEN 'error' THEN 'block' ELSE 'pass' END AS event", "value")


@query(_EP + " SELECT * FROM e")
def w7_episodes(spark, d):
    return H.episodes(_log(spark, d), ["user_id", "metric"])


@query(_EP + " SELECT resolution, count(*) AS n FROM (SELECT CASE WHEN resolved_at IS NULL THEN 'open' WHEN head > 0 AND (head - passed) / head >= 0.25 THEN 'split' WHEN passed < head THEN 'reduced' ELSE 'unexplained' END AS resolution FROM e) GROUP BY resolution")
def w8_resolutions(spark, d):
    e = H.episodes(_log(spark, d), ["user_id", "metric"])
    return e.select(H.resolution(F.col("head"), F.col("passed"), F.col("resolved_at")).alias("resolution")).groupBy("resolution").agg(F.count("*").alias("n"))


@query(_EP + " SELECT user_id, metric, blocks, blocked_at FROM e WHERE resolved_at IS NULL")
def j24_open_blocks(spark, d):
    return H.episodes(_log(spark, d), ["user_id", "metric"]).where("resolved_at is null").select("user_id", "metric", "blocks", "blocked_at")


_CARRY = "SELECT o_custkey AS k, o_orderkey AS seq, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_totalprice AS BIGINT) END AS base, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_totalprice AS BIGINT) + 7 END AS head, o_orderkey % 7 = 0 AS deleted FROM orders"


@query(f"SELECT k, seq, coalesce(base, last_value(CASE WHEN deleted THEN 0 ELSE head END IGNORE NULLS) OVER (PARTITION BY k ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), first_value(base IGNORE NULLS) OVER (PARTITION BY k ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS before FROM ({_CARRY.replace('CAST(o_totalprice AS BIGINT)', 'CAST(floor(o_totalprice) AS BIGINT)')})")
def w6_carried(spark, d):
    o = table(spark, d, "orders").selectExpr("o_custkey AS k", "o_orderkey AS seq", "CASE WHEN o_orderkey % 3 = 0 THEN floor(o_totalprice) END AS base", "CASE WHEN o_orderkey % 2 = 0 THEN floor(o_totalprice) + 7 END AS head", "o_orderkey % 7 = 0 AS deleted")
    return H.carried_before(o, ["k"]).select("k", "seq", "before")


@query("SELECT user_id, event_id, coalesce(max(reach) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (SELECT user_id, event_id, event_id + CAST(floor(value) AS BIGINT) AS reach FROM events)")
def w2_running_reach(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", (F.col("event_id") + F.floor("value")).alias("reach"))
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    return e.select("user_id", "event_id", F.coalesce(F.max("reach").over(w), F.lit(0)).alias("before"))


@query("WITH x AS (SELECT user_id, event_id AS lo, event_id + CAST(floor(value) AS BIGINT) AS hi FROM events WHERE value >= 1), s AS (SELECT *, CASE WHEN lo <= max(hi) OVER (PARTITION BY user_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS f FROM x), g AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS i FROM s) SELECT user_id, CAST(sum(h - l) AS BIGINT) AS covered, count(*) AS runs FROM (SELECT user_id, i, min(lo) AS l, max(hi) AS h FROM g GROUP BY ALL) GROUP BY user_id")
def w4_interval_union(spark, d):
    x = table(spark, d, "events").where("value >= 1").select("user_id", F.col("event_id").alias("lo"), (F.col("event_id") + F.floor("value")).alias("hi"))
    w = Window.partitionBy("user_id").orderBy("lo", "hi")
    s = x.withColumn("f", F.when(F.col("lo") <= F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1)), 0).otherwise(1))
    g = s.withColumn("i", F.sum("f").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = g.groupBy("user_id", "i").agg(F.min("lo").alias("l"), F.max("hi").alias("h"))
    return runs.groupBy("user_id").agg(F.sum(F.col("h") - F.col("l")).alias("covered"), F.count("*").alias("runs"))


@query("SELECT p_brand, p_partkey, p_size FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS rn FROM part) WHERE rn <= 3")
def o8_hardest(spark, d):
    """The hardest three of each package, the first on ties."""
    w = Window.partitionBy("p_brand").orderBy(F.col("p_size").desc(), "p_partkey")
    return table(spark, d, "part").withColumn("rn", F.row_number().over(w)).where("rn <= 3").select("p_brand", "p_partkey", "p_size")


@query("SELECT l_orderkey, l_linenumber, l_quantity <= coalesce(lag(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity), -1) AS overlaps FROM lineitem")
def w10_self_overlap(spark, d):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_quantity")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") <= F.coalesce(F.lag("l_quantity").over(w), F.lit(-1))).alias("overlaps"))


# Labels as verdicts: a document is blocked where its quality label is 0; rules read its statistics.
_FACTS = {"chars": "n_chars", "words": "length(text) - length(replace(text, ' ', ''))", "lines": "length(text) - length(replace(text, chr(10), ''))"}
_GRID = {"chars": (100, 500, 1000, 2000, 4000, 8000), "words": (20, 100, 200, 400, 800), "lines": (0, 1, 5, 20, 80)}
_SHIPPED = {"chars": 2000, "words": 200, "lines": 5}
_ROWS = "(" + " UNION ALL ".join(f"SELECT d.doc_id, d.source, '{r}' AS rule, CAST({e} AS BIGINT) AS fact, l.quality = 0 AS block FROM documents d JOIN labels l USING (doc_id) WHERE l.quality IS NOT NULL AND text IS NOT NULL" for r, e in _FACTS.items()) + ")"
_SET = "(SELECT * FROM (VALUES " + ", ".join(f"('{r}', {v}, {str(v == _SHIPPED[r]).upper()})" for r, g in _GRID.items() for v in g) + ") s(rule, value, shipped))"
_RATES = "count(*) FILTER (block) AS blocks, count(*) FILTER (NOT block) AS allows, count(*) FILTER (block AND failed) AS block_failed, count(*) FILTER (NOT block AND failed) AS allow_failed"
_DERIVED = "*, CASE WHEN blocks = 0 THEN 0.0 ELSE CAST(block_failed AS DOUBLE) / blocks END AS recall, CASE WHEN allows = 0 THEN 0.0 ELSE CAST(allow_failed AS DOUBLE) / allows END AS false_failure, CASE WHEN block_failed + allow_failed > 0 THEN CAST(block_failed AS DOUBLE) / (block_failed + allow_failed) END AS precision"
_SWEEP = f"WITH p0 AS (SELECT r.rule, value, shipped, {_RATES} FROM (SELECT r.*, s.value, s.shipped, fact > s.value AS failed FROM {_ROWS} r JOIN {_SET} s USING (rule)) r GROUP BY ALL), p1 AS (SELECT {_DERIVED} FROM p0), p AS (SELECT *, recall - false_failure AS j FROM p1)"


def _rows(spark, d):
    docs = table(spark, d, "documents").where("text is not null")
    labels = table(spark, d, "labels").where("quality is not null")
    met = docs.select("doc_id", "source", *[F.expr(e).cast("bigint").alias(r) for r, e in _FACTS.items()]).join(labels.select("doc_id", (F.col("quality") == 0).alias("block")), "doc_id")
    cells = F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("fact")) for r in _FACTS])
    return met.select("doc_id", "source", "block", F.explode(cells).alias("c")).select("doc_id", "source", "block", "c.rule", "c.fact")


def _settings(spark):
    return spark.createDataFrame([(r, v, v == _SHIPPED[r]) for r, g in _GRID.items() for v in g], "rule string, value int, shipped boolean")


def _points(spark, d):
    return H.sweep(_rows(spark, d), _settings(spark))


@query(_SWEEP + " SELECT * FROM p")
def c8_sweep(spark, d):
    return _points(spark, d)


@query(_SWEEP + " SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY block_failed DESC, allow_failed, shipped DESC, value) AS rn FROM p WHERE false_failure <= 0.3) WHERE rn = 1")
def o9_best_within(spark, d):
    return H.best_within(_points(spark, d), 0.3)


@query(_SWEEP + " SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY allow_failed, value) AS rn FROM p) WHERE rn = 1")
def o9_least_false(spark, d):
    return H.least_false(_points(spark, d))


@query(_SWEEP + ", b AS (SELECT rule, value AS best, block_failed AS b FROM (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY block_failed DESC, allow_failed, shipped DESC, value) AS rn FROM p WHERE false_failure <= 0.3) WHERE rn = 1) SELECT rule, a AS advice, CASE WHEN a = 'retune' THEN best ELSE now END AS value FROM (SELECT p.rule, p.value AS now, best, CASE WHEN best IS NULL OR b = 0 THEN 'drop' WHEN false_failure <= 0.3 AND block_failed >= b THEN 'keep' ELSE 'retune' END AS a FROM p LEFT JOIN b USING (rule) WHERE shipped)")
def c10_advice(spark, d):
    return H.advice(_points(spark, d), 0.3)


@query(f"WITH p0 AS (SELECT rule, source, {_RATES} FROM (SELECT *, fact > CASE rule WHEN 'chars' THEN 2000 WHEN 'words' THEN 200 ELSE 5 END AS failed FROM {_ROWS}) GROUP BY ALL), p1 AS (SELECT {_DERIVED} FROM p0) SELECT *, recall - false_failure AS j FROM p1")
def a26_rates(spark, d):
    shipped = F.when(F.col("rule") == "chars", 2000).when(F.col("rule") == "words", 200).otherwise(5)
    return H.rates(_rows(spark, d).withColumn("failed", F.col("fact") > shipped), ["rule", "source"])


@query(f"SELECT source, count(*) AS n, count(*) FILTER (block) AS blocks FROM {_ROWS} WHERE rule = 'chars' GROUP BY ROLLUP (source)")
def a30_views(spark, d):
    """Each corpus and all of them pooled."""
    return H.views(_rows(spark, d).where("rule = 'chars'"), "source")


@query("SELECT l_orderkey AS commit, l_returnflag AS rule, bool_or(l_discount > 0.08) AS failed FROM lineitem GROUP BY ALL")
def a27_commit_verdicts(spark, d):
    return H.verdict_by_commit(table(spark, d, "lineitem").selectExpr("l_orderkey AS commit", "l_returnflag AS rule", "l_discount > 0.08 AS failed"))


@query("SELECT c, n, s, CASE WHEN n > 0 THEN round(m * 1e6) / 1e6 END AS median FROM (SELECT o_orderpriority AS c, count(*) FILTER (o_orderstatus = 'F') AS n, count(*) FILTER (o_orderstatus = 'P') AS s, quantile_cont(o_totalprice, 0.5) FILTER (o_orderstatus = 'F') AS m FROM orders GROUP BY ALL)")
def a29_medians(spark, d):
    """Passing runs' median, the mean of the middle two; others counted apart."""
    g = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("c"))
    done = F.col("o_orderstatus") == "F"
    return g.agg(F.count_if(done).alias("n"), F.count_if(F.col("o_orderstatus") == "P").alias("s"), round_to(F.percentile(F.when(done, F.col("o_totalprice")), 0.5), 6).alias("median"))


@query("SELECT o_orderkey AS commit FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 5)")
def t1_pending(spark, d):
    commits = table(spark, d, "orders").selectExpr("o_orderkey AS commit", "o_orderkey AS seq", "'v1' AS version")
    done = table(spark, d, "lineitem").where("l_linenumber = 5").selectExpr("l_orderkey AS commit", "'v1' AS version").distinct()
    return H.pending(commits, done).select("commit")


_SUBJECT = "CASE p_partkey % 7 WHEN 0 THEN ' Fixed: ' || p_name WHEN 1 THEN 'Revert \"' || p_name || '\" (#2)' WHEN 2 THEN 'THIS reverts commit abcdef' || p_partkey || ' now, and this reverts commit 0123456' WHEN 3 THEN 'fixture ' || p_name WHEN 4 THEN 'prefix fix' WHEN 5 THEN 'reverting' ELSE p_name END"


@query(f"SELECT p_partkey, regexp_matches(lower(trim(s)), '^\\s*(fix|revert)(s|es|ed|ing|up)?([^a-z]|$)') AS is_fix, CASE WHEN regexp_matches(s, '^Revert \".*\"') THEN regexp_extract(s, '^Revert \"(.*)\"', 1) END AS reverted_subject, array_to_string(regexp_extract_all(lower(s), 'this reverts commit ([0-9a-f]{{7,}})', 1), ',') AS reverted_hashes FROM (SELECT p_partkey, {_SUBJECT} AS s FROM part)")
def p20_subjects(spark, d):
    rows = H.subject_facts(table(spark, d, "part").select("p_partkey", F.expr(_SUBJECT).alias("s")), "s")
    return rows.select("p_partkey", "is_fix", "reverted_subject", F.array_join("reverted_hashes", ",").alias("reverted_hashes"))


_REASON = "CASE l_orderkey % 7 WHEN 0 THEN 'fixed up by x' WHEN 1 THEN 'reverted by x' ELSE 'too large' END"


@query(f"WITH x AS (SELECT l_orderkey AS c, l_orderkey % 4 <> 0 AS block, {_REASON} AS reason, list(l_returnflag) FILTER (l_linenumber > 2) AS m, count(*) FILTER (l_discount > 0.09) AS f FROM lineitem GROUP BY ALL) SELECT c, block AND reason = 'too large' AND len(coalesce(m, [])) > 0 AND f = 0 AND len(list_filter(coalesce(m, []), lambda v: v = 'R')) = 0 AS capacity_only FROM x")
def p21_capacity_only(spark, d):
    flag = F.when(F.col("l_linenumber") > 2, F.when(F.col("l_returnflag") == "R", "globals").otherwise("sloc"))
    x = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("c")).agg(F.collect_list(flag).alias("metrics"), F.collect_list(F.when(F.col("l_discount") > 0.09, F.lit("e"))).alias("fired"))
    x = x.withColumn("block", F.expr("c % 4 <> 0")).withColumn("reason", F.expr(_REASON.replace("l_orderkey", "c")))
    return x.select("c", H.capacity_only(x).alias("capacity_only"))