"""Distributions, fits, ranks and regressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import scalar as S
from plumbline.operators import aggregates as A
from plumbline.operators import model as N
from plumbline.operators import regress as R
from plumbline.sources.host import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _r(v, k):
    return f"(round(({v}) * 1e{k}) / 1e{k})"


_PCT = ", ".join(f"quantile_disc(v, {p / 100}) AS p{p}" for p in (25, 50, 75, 90, 95, 99))
_DIST = f"SELECT k, count(v) AS n, min(v) AS min, max(v) AS max, {_PCT}, quantile_disc(v, 0.75) - quantile_disc(v, 0.25) AS iqr FROM (SELECT l_suppkey AS k, CAST(l_extendedprice AS BIGINT) AS v FROM lineitem) GROUP BY k"


def _prices(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("k"), F.floor("l_extendedprice").alias("v"))


@query(_DIST.replace("CAST(l_extendedprice AS BIGINT)", "CAST(floor(l_extendedprice) AS BIGINT)"))
def a22_distribution(spark, d):
    return A.distribution(_prices(spark, d), "k", "v")


@query("WITH x AS (SELECT l_suppkey AS k, CAST(floor(l_extendedprice) AS BIGINT) AS v FROM lineitem), s AS (SELECT k, min(v) AS lo, quantile_disc(v, 0.95) AS hi FROM x GROUP BY k) SELECT k, CAST(CASE WHEN v > hi THEN 9 WHEN hi = lo THEN 0 ELSE least(floor((v - lo) / (CAST(hi - lo AS DOUBLE) / 9)), 8) END AS INT) AS bin, count(*) AS count FROM x JOIN s USING (k) GROUP BY ALL")
def a23_histogram(spark, d):
    return A.histogram(_prices(spark, d), "k", "v")


@query("WITH m AS (SELECT o_custkey % 40 AS k, CAST(o_totalprice / 50000 AS BIGINT) AS value, count(*) AS n FROM orders GROUP BY ALL) SELECT k, CAST(quantile_disc(v, 0.9) AS BIGINT) AS value FROM (SELECT o_custkey % 40 AS k, CAST(floor(o_totalprice / 50000) AS BIGINT) AS v FROM orders) GROUP BY k")
def a24_weighted_percentile(spark, d):
    """Maps of value to count, pooled; the percentile walks the counts and never expands them."""
    o = table(spark, d, "orders").selectExpr("o_custkey % 40 AS k", "o_custkey % 3 AS part", "floor(o_totalprice / 50000) AS v")
    maps = o.groupBy("k", "part", "v").agg(F.count("*").alias("n")).groupBy("k", "part").agg(F.map_from_entries(F.collect_list(F.struct("v", "n"))).alias("counts"))
    return A.weighted_percentile(A.weighted_values(maps, "k"), "k", 0.9)


_READ = lambda v: f"(CASE WHEN {v} = 0 THEN 0.0 ELSE (SELECT round(two / st) * st FROM (SELECT two, CASE WHEN abs(two) > 1000 THEN 500.0 WHEN abs(two) > 100 THEN 50.0 WHEN abs(two) > 10 THEN 5.0 ELSE 1.0 END AS st FROM (SELECT round({v} / pow(10.0, floor(log10(abs({v}))) - 1)) * pow(10.0, floor(log10(abs({v}))) - 1) AS two))) END)"


@query(f"WITH s AS (SELECT l_suppkey AS k, quantile_disc(v, 0.9) AS p90, quantile_disc(v, 0.99) AS p99, quantile_disc(v, 0.75) - quantile_disc(v, 0.25) AS iqr FROM (SELECT l_suppkey, CAST(floor(l_extendedprice / 100) AS BIGINT) AS v FROM lineitem) GROUP BY ALL), t AS (SELECT k, {_READ('p90')} AS max, {_READ('p99')} AS ceiling, greatest(ceil(iqr / 4.0 - 1e-9), 1.0) AS max_delta FROM s) SELECT t.*, (SELECT count(*) FROM lineitem WHERE l_suppkey = t.k AND floor(l_extendedprice / 100) > t.max) AS over FROM t")
def a25_fit(spark, d):
    """Limits from a corpus: the 90th and 99th percentile made readable, a quarter of the spread as
    the step, and how many are over the limit."""
    x = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("k"), F.floor(F.col("l_extendedprice") / 100).alias("v"))
    s = A.distribution(x, "k", "v").select("k", S.readable(F.col("p90")).alias("max"), S.readable(F.col("p99")).alias("ceiling"), S.delta_from_iqr(F.col("iqr")).alias("max_delta"))
    over = x.join(s.select("k", "max"), "k").where(F.col("v") > F.col("max")).groupBy("k").agg(F.count("*").alias("over"))
    return s.join(over, "k", "left").withColumn("over", F.coalesce("over", F.lit(0)))


@query("SELECT p_partkey, rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2.0 AS place FROM part")
def w1_mean_ranks(spark, d):
    return A.mean_ranks(table(spark, d, "part"), "p_brand", "p_size", "place").select("p_partkey", "place")


@query(f"WITH r AS (SELECT p_brand AS k, p_size AS x, p_retailprice AS y, rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_brand, p_retailprice) - 1) / 2.0 AS ry FROM part) SELECT k, count(*) AS n, {_r('corr(x, y)', 9)} AS pearson, {_r('corr(rx, ry)', 9)} AS spearman FROM r GROUP BY k")
def c4_correlation(spark, d):
    x = table(spark, d, "part").selectExpr("p_brand AS k", "p_size AS x", "p_retailprice AS y")
    return R.correlations(x, "k", "x", "y").select("k", "n", S.round_to("pearson", 9).alias("pearson"), S.round_to("spearman", 9).alias("spearman"))


@query(f"SELECT 'l_quantity' AS name, {_r('regr_slope(l_extendedprice, l_quantity)', 4)} AS coef, {_r('regr_r2(l_extendedprice, l_quantity)', 8)} AS r2, count(*) AS n FROM lineitem UNION ALL SELECT 'intercept', {_r('regr_intercept(l_extendedprice, l_quantity)', 4)}, {_r('regr_r2(l_extendedprice, l_quantity)', 8)}, count(*) FROM lineitem")
def c1_ols_one(spark, d):
    fit = R.ols(table(spark, d, "lineitem"), "l_extendedprice", ["l_quantity"])
    rows = [(n, float(c), float(fit.r2), fit.n) for n, c in zip(fit.names, fit.coef)]
    out = spark.createDataFrame(rows, "name string, c double, r double, n long")
    return out.select("name", S.round_to("c", 4).alias("coef"), S.round_to("r", 8).alias("r2"), "n")


_HC3 = f"""WITH s AS (SELECT count(*) AS n, sum(l_discount) AS sx, sum(l_discount * l_discount) AS sxx, sum(l_extendedprice) AS sy, sum(l_discount * l_extendedprice) AS sxy FROM lineitem),
i AS (SELECT *, sxx / (n * sxx - sx * sx) AS i11, -sx / (n * sxx - sx * sx) AS i12, n / (n * sxx - sx * sx) AS i22, (n * sxy - sx * sy) / (n * sxx - sx * sx) AS b1 FROM s),
j AS (SELECT *, (sy - b1 * sx) / n AS b0 FROM i),
w AS (SELECT sum(v) AS m11, sum(v * x) AS m12, sum(v * x * x) AS m22 FROM (SELECT l_discount AS x, pow((l_extendedprice - b0 - b1 * l_discount) / (1 - least(i11 + 2 * i12 * l_discount + i22 * l_discount * l_discount, 0.99)), 2) AS v FROM lineitem, j))
SELECT 'intercept' AS name, {_r('b0', 3)} AS coef, {_r('sqrt(i11 * i11 * m11 + 2 * i11 * i12 * m12 + i12 * i12 * m22)', 3)} AS se FROM j, w UNION ALL SELECT 'l_discount', {_r('b1', 3)}, {_r('sqrt(i12 * i12 * m11 + 2 * i12 * i22 * m12 + i22 * i22 * m22)', 3)} FROM j, w"""


@query(_HC3)
def c1_hc3_one(spark, d):
    """Price on discount, with HC3 errors."""
    fit = R.ols(table(spark, d, "lineitem"), "l_extendedprice", ["l_discount"])
    out = spark.createDataFrame([(n, float(c), float(s)) for n, c, s in zip(fit.names, fit.coef, fit.se)], "name string, c double, s double")
    return out.select("name", S.round_to("c", 3).alias("coef"), S.round_to("s", 3).alias("se"))


@query()
def c1_ols_hc3(spark, d):
    """Price on quantity, discount and tax, with HC3 errors; held against a dense fit in the tests."""
    fit = R.ols(table(spark, d, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount", "l_tax"])
    rows = [(n, float(c), float(s)) for n, c, s in zip(fit.names, fit.coef, fit.se)]
    return spark.createDataFrame(rows, "name string, coef double, se double")


_INPUTS = {"volume": "sum(l_quantity) * 40", "spec": "sum(l_linenumber) * 25", "exports": "count(DISTINCT l_partkey) % 80", "untested": "count_if(l_returnflag = 'A') % 40", "hidden": "count_if(l_linenumber = 7) % 9"}


def _runs(spark, d):
    """A supplier's line items as runs: what one takes follows from the supplier's inputs, plus what differs by run."""
    rows = table(spark, d, "lineitem")
    x = rows.groupBy(F.col("l_suppkey").alias("package")).agg(*[F.expr(e).cast("double").alias(n) for n, e in _INPUTS.items()])
    cost = F.col("volume") + F.col("spec") + F.col("exports") * 150 + F.col("untested") * 400 + F.col("hidden") * 90
    runs = rows.select(F.col("l_suppkey").alias("package"), (F.col("l_partkey") % 7 != 0).alias("passed"), (F.col("l_tax") * 100).alias("noise")).join(x, "package")
    return runs.withColumn("tokens", 8000 + 1.3 * cost * (1 + (F.col("noise") - 4) / 400))


@query()
def c5_form_fit(spark, d):
    """The rebuild form fitted to the median tokens of passing runs; the tests plant its parameters."""
    x, y = N.matrix(N.observations(_runs(spark, d), list(_INPUTS)))
    fit = N.fit_form(x, y, N.Form())
    rows = [(n, float(getattr(fit.form, n)), fit.se.get(n), fit.fixed.get(n)) for n in ("overhead", "scale", *N.COSTS, "exponent")]
    return spark.createDataFrame(rows, "name string, value double, se double, fixed string")


@query()
def c6_budget_profile(spark, d):
    """The fit at several budgets, and whether one is better than the shipped."""
    x, y = N.matrix(N.observations(_runs(spark, d), list(_INPUTS)))
    fits = N.profile(x, y, N.Form(), [20_000.0, 37_500.0, 75_000.0, 150_000.0])
    best, sure = N.best_budget(fits, 37_500.0)
    return spark.createDataFrame([(b, float(f.sse), float(f.r2), b == best, sure and b == best) for b, f in fits.items()], "budget double, sse double, r2 double, best boolean, significant boolean")


@query()
def c7_contributions(spark, d):
    """What each input, and a flag beside the form, adds to measured tokens."""
    x, y = N.matrix(N.observations(_runs(spark, d), list(_INPUTS)))
    form = N.fit_form(x, y, N.Form()).form
    got = N.contributions(x, y, {"even": (x[:, 2] % 2 == 0).astype(float)}, lambda v: N.linearized(form, v))
    return spark.createDataFrame([(c.name, c.in_form, c.coef, c.significant, c.verdict) for c in got], "name string, in_form boolean, coef double, significant boolean, verdict string")
