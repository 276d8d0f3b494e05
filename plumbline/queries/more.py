"""Further matching and selection operators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

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


@query("SELECT l_orderkey AS rule, bool_and(l_discount > 0.0 OR l_tax > 0.02) AS warned FROM lineitem GROUP BY ALL")
def j26_every_some(spark, d):
    """A rule warned if each of its violations has some cause over budget."""
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("rule"), F.array(F.col("l_discount") > 0, F.col("l_tax") > 0.02).alias("causes"))
    return rows.groupBy("rule").agg(F.bool_and(F.exists("causes", lambda c: c)).alias("warned"))


@query("SELECT p_brand, p_partkey, p_size > 25 AS is_new, row_number() OVER (PARTITION BY p_brand ORDER BY p_size <= 25, p_partkey) AS place FROM part")
def o6_new_first(spark, d):
    w = Window.partitionBy("p_brand").orderBy(F.col("p_size") <= 25, "p_partkey")
    return table(spark, d, "part").select("p_brand", "p_partkey", (F.col("p_size") > 25).alias("is_new"), F.row_number().over(w).alias("place"))


@query("SELECT o_orderkey, a + b + c AS total FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_custkey END AS a, o_orderkey AS b, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE 1 END AS c FROM orders)")
def r26_token_measure(spark, d):
    """An unknown part makes the sum unknown."""
    return table(spark, d, "orders").selectExpr("o_orderkey", "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_custkey END + o_orderkey + CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE 1 END AS total")


@query("WITH RECURSIVE e AS (SELECT DISTINCT l_orderkey AS source, l_partkey * 7 AS target FROM lineitem), r AS (SELECT 7 AS package UNION SELECT e.source FROM e JOIN r ON e.target = r.package) SELECT package FROM r")
def r3_transitive_importers(spark, d):
    """Everything that links package 7: importers of importers, until none is new."""
    edges = table(spark, d, "lineitem").selectExpr("l_orderkey AS source", "l_partkey * 7 AS target")
    return M.reaching(edges, spark.createDataFrame([(7,)], "package bigint"))


@query("SELECT source, pkg, n, row_number() OVER (ORDER BY n DESC, source, pkg) AS place FROM (SELECT source, lang AS pkg, count(*) AS n FROM documents GROUP BY ALL) QUALIFY place <= 5")
def o5_most_first(spark, d):
    """Counts most first, ties by key, five of them: a top-k report."""
    counts = table(spark, d, "documents").groupBy("source", F.col("lang").alias("pkg")).agg(F.count("*").alias("n"))
    five = counts.orderBy(F.col("n").desc(), "source", "pkg").limit(5)
    return five.withColumn("place", F.row_number().over(Window.orderBy(F.col("n").desc(), "source", "pkg")))
