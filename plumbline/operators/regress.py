"""Regression: distributed cross products, small dense algebra on the driver."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAX_LEVERAGE = 0.99


class SingularColumn(ValueError):
    """A column that is all zero or that the others determine."""


def invert(m: np.ndarray, names: list[str] | None = None, tolerance: float = 1e-10) -> np.ndarray:
    """Gauss-Jordan on the matrix scaled to unit diagonal; a pivot below the tolerance names its column."""
    diagonal = np.diag(m)
    if (diagonal <= 0).any():
        i = int(np.flatnonzero(diagonal <= 0)[0])
        raise SingularColumn(f"column {names[i] if names else i} is all zero")
    scale = np.sqrt(diagonal)
    a = np.hstack([m / np.outer(scale, scale), np.eye(len(m))])
    for i in range(len(m)):
        j = i + int(np.abs(a[i:, i]).argmax())
        if abs(a[j, i]) < tolerance:
            raise SingularColumn(f"column {names[i] if names else i} depends on the others")
        a[[i, j]] = a[[j, i]]
        a[i] /= a[i, i]
        for r in range(len(m)):
            if r != i:
                a[r] -= a[r, i] * a[i]
    return a[:, len(m) :] / np.outer(scale, scale)


@dataclass(frozen=True)
class Fit:
    names: list[str]
    coef: np.ndarray
    se: np.ndarray
    cov: np.ndarray
    sse: float
    r2: float
    adj_r2: float
    n: int


def ols(rows: DataFrame, y: str, xs: list[str]) -> Fit:
    """Least squares with an intercept and HC3 covariance, in two passes over the rows. Only sums of products
    (a matrix of the number of columns squared) come to the driver."""
    cols = ["__one", *xs]
    data = rows.select(F.lit(1.0).alias("__one"), *[F.col(c).cast("double").alias(c) for c in (*xs, y)]).dropna()
    p = len(cols)
    sums = [F.sum(F.col(cols[i]) * F.col(cols[j])).alias(f"m{i}_{j}") for i in range(p) for j in range(i, p)]
    got = data.agg(F.count("*").alias("n"), F.avg(y).alias("mean"), *sums, *[F.sum(F.col(c) * F.col(y)).alias(f"v{i}") for i, c in enumerate(cols)]).first()
    n = got["n"]
    if n <= p:
        raise ValueError(f"ols: {n} observations for {p} parameters")
    xtx = np.array([[got[f"m{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)])
    inv = invert(xtx, cols)
    coef = inv @ np.array([got[f"v{i}"] for i in range(p)])
    fitted = sum((F.col(c) * float(b) for c, b in zip(cols[1:], coef[1:])), F.lit(float(coef[0])))
    lever = sum((F.col(cols[i]) * F.col(cols[j]) * float(inv[i, j]) for i in range(p) for j in range(p)), F.lit(0.0))
    e = F.col(y) - fitted
    w = (e * e) / F.pow(1 - F.least(lever, F.lit(MAX_LEVERAGE)), F.lit(2.0))
    second = data.agg(F.sum(e * e).alias("sse"), F.sum(F.pow(F.col(y) - float(got["mean"]), F.lit(2.0))).alias("sst"), *[F.sum(w * F.col(cols[i]) * F.col(cols[j])).alias(f"m{i}_{j}") for i in range(p) for j in range(i, p)]).first()
    meat = np.array([[second[f"m{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)])
    cov = inv @ meat @ inv
    r2 = 1 - second["sse"] / second["sst"]
    return Fit(["intercept", *xs], coef, np.sqrt(np.maximum(np.diag(cov), 0)), cov, second["sse"], r2, 1 - (1 - r2) * (n - 1) / (n - p), n)


def levenberg_marquardt(f, start: np.ndarray, y: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Damped least squares of f(params) -> fitted, with numeric derivatives."""
    b, damp = np.array(start, float), 1e-3
    res = y - f(b)
    for _ in range(rounds):
        step = 1e-6 * np.maximum(1, np.abs(b))
        jac = np.stack([(f(b + np.eye(len(b))[i] * step[i]) - f(b - np.eye(len(b))[i] * step[i])) / (2 * step[i]) for i in range(len(b))], axis=1)
        a, g = jac.T @ jac, jac.T @ res
        move = np.linalg.lstsq(a + damp * np.diag(np.maximum(np.diag(a), 1e-12)), g, rcond=None)[0]
        after = y - f(b + move)
        if after @ after < res @ res:
            done = res @ res - after @ after <= 1e-14 * max(1.0, res @ res)
            b, res, damp = b + move, after, damp / 10
            if done:
                break
        else:
            damp *= 10
            if damp > 1e12:
                break
    return b


def correlations(rows: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """key, n, pearson, spearman; null below three rows or where a side is constant."""
    w = lambda c: Window.partitionBy(key).orderBy(c)
    tie = lambda c: (F.count("*").over(Window.partitionBy(key, c)) - 1) / 2
    ranked = rows.select(key, x, y).dropna().withColumn("__x", F.rank().over(w(x)) + tie(x)).withColumn("__y", F.rank().over(w(y)) + tie(y))
    varies = (F.count("*") >= 3) & (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
    return ranked.groupBy(key).agg(F.count("*").alias("n"), F.when(varies, F.corr(x, y)).alias("pearson"), F.when(varies, F.corr("__x", "__y")).alias("spearman"))


def t_critical_95(df: int) -> float:
    """Two-sided 95% point of Student's t, by bisection on the distribution's integral."""
    from math import exp, lgamma, pi, sqrt

    if df < 1:
        raise ValueError("needs at least one degree of freedom")
    scale = exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(df * pi)

    def tail(t: float) -> float:
        # the density over x = t / (1 - u), u from 0 to 1, by Simpson's rule
        n, total = 4000, scale if df == 1 else 0.0  # the limit at u = 1
        for i in range(n):
            u = i / n
            x = t + u / (1 - u)
            v = scale * (1 + x * x / df) ** (-(df + 1) / 2) / (1 - u) ** 2
            total += v * (1 if i == 0 else 4 if i % 2 else 2)
        return total / (3 * n)

    lo, hi = 0.0, 1000.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if tail(mid) > 0.025 else (lo, mid)
    return (lo + hi) / 2


def significant(r: float, n: int) -> bool:
    """Whether a correlation of n pairs differs from 0 at 95%."""
    if n < 3 or abs(r) >= 1:
        return n >= 3
    return abs(r) * ((n - 2) / (1 - r * r)) ** 0.5 > t_critical_95(n - 2)


def two_figures(v: float) -> float:
    """Rounded to two significant figures."""
    return 0.0 if v == 0 else float(f"{v:.1e}")
