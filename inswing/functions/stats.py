"""Closed-form statistics as column expressions."""
from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType

from inswing.functions.special import beta_i, gamma_p

Z90 = 1.6448536269514722
Z99 = 2.576
ERFC_TERMS = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)  # Abramowitz and Stegun 7.1.26
ERFC_P = 0.3275911


def _d(x) -> Column:
    return (F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)).cast("double")


def erfc(x: Column) -> Column:
    """Complementary error function for x >= 0, absolute error below 1.5e-7."""
    t = 1.0 / (1.0 + ERFC_P * x)
    poly = F.lit(0.0)
    for a in reversed(ERFC_TERMS):
        poly = (poly + a) * t
    return poly * F.exp(-x * x)


def two_sided(z: Column) -> Column:
    """Two-sided normal p value."""
    return erfc(F.abs(z) / math.sqrt(2))


def wilson(x, n, z: float = Z90) -> Column:
    """struct(lo, hi): interval of a share."""
    x, n = _d(x), F.nullif(_d(n), F.lit(0.0))
    p = x / n
    den = 1 + z * z / n
    mid = (p + z * z / (2 * n)) / den
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / den
    return F.struct(F.when(n.isNotNull(), F.greatest(F.lit(0.0), mid - half)).alias("lo"),
                    F.when(n.isNotNull(), F.least(F.lit(1.0), mid + half)).alias("hi"))


def shrink(x, n, prior, k: float) -> Column:
    """Rate pulled towards a prior by k pseudo-observations."""
    return (_d(x) + k * _d(prior)) / (_d(n) + k)


def rate_ratio(x1, n1, x0, n0, z: float = Z90) -> Column:
    """struct(ratio, lo, hi, p): ratio of two rates with a log interval; a zero count becomes one half."""
    def half(x):
        return F.when(_d(x) == 0, 0.5).otherwise(_d(x))
    n1, n0 = F.nullif(_d(n1), F.lit(0.0)), F.nullif(_d(n0), F.lit(0.0))
    a, b = half(x1), half(x0)
    r = (a / n1) / (b / n0)
    se = F.sqrt(F.greatest(F.lit(1e-12), 1 / a - 1 / n1 + 1 / b - 1 / n0))
    ok = n1.isNotNull() & n0.isNotNull()
    return F.struct(r.alias("ratio"), (r * F.exp(-z * se)).alias("lo"), (r * F.exp(z * se)).alias("hi"),
                    F.when(ok, two_sided(F.ln(r) / se)).alias("p"))


def mean_diff(s1, q1, n1, s0, q0, n0, z: float = Z90) -> Column:
    """struct(diff, lo, hi, p) from sums, sums of squares and counts of two samples."""
    s1, q1, n1, s0, q0, n0 = (_d(v) for v in (s1, q1, n1, s0, q0, n0))
    ok = (n1 >= 2) & (n0 >= 2)
    m1, m0 = s1 / F.nullif(n1, F.lit(0.0)), s0 / F.nullif(n0, F.lit(0.0))

    def var(q, n, m):
        return F.greatest(F.lit(1e-9), (q - n * m * m) / F.nullif(n - 1, F.lit(0.0)))
    se = F.sqrt(var(q1, n1, m1) / F.nullif(n1, F.lit(0.0)) + var(q0, n0, m0) / F.nullif(n0, F.lit(0.0)))
    d = m1 - m0
    return F.struct(F.when(ok, d).alias("diff"), F.when(ok, d - z * se).alias("lo"), F.when(ok, d + z * se).alias("hi"),
                    F.when(ok, two_sided(d / se)).alias("p"))


def poisson_interval(k, z: float = Z90) -> Column:
    """struct(lo, hi): interval of a count; a zero count has a one-sided upper bound."""
    k = _d(k)
    some = F.nullif(k, F.lit(0.0))

    def edge(v, sign):
        return v * F.pow(1 - 1 / (9 * v) + sign * z / (3 * F.sqrt(v)), F.lit(3.0))
    return F.struct(F.when(k == 0, 0.0).otherwise(F.greatest(F.lit(0.0), edge(some, -1))).alias("lo"),
                    F.when(k == 0, -math.log(1 - 0.90)).otherwise(edge(k + 1, 1)).alias("hi"))


@F.pandas_udf(DoubleType())
def _poisson_tail(k: pd.Series, rate: pd.Series) -> pd.Series:
    k, rate = k.to_numpy(float), rate.to_numpy(float)
    known = ~(np.isnan(k) | np.isnan(rate))
    out = np.where(k <= 0, 1.0, 0.0)
    some = known & (k > 0) & (rate > 0)
    out[some] = gamma_p(np.floor(k[some]), rate[some])
    return pd.Series(np.where(known, out, np.nan)).where(known)


def poisson_tail(k, rate) -> Column:
    """P(X >= k) for a Poisson count: the incomplete gamma function, which has no built-in, as an Arrow UDF over whole batches."""
    return F.greatest(F.lit(1e-300), _poisson_tail(_d(k), _d(rate)))


@F.pandas_udf(DoubleType())
def _binomial_tail(k: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
    k, n, p = k.to_numpy(float), n.to_numpy(float), p.to_numpy(float)
    known = ~(np.isnan(k) | np.isnan(n) | np.isnan(p))
    out = np.where((k <= 0) | (p >= 1), 1.0, 0.0)
    some = known & (k > 0) & (k <= n) & (p > 0) & (p < 1)
    out[some] = beta_i(np.floor(k[some]), np.floor(n[some]) - np.floor(k[some]) + 1, p[some])
    return pd.Series(np.where(known, out, np.nan)).where(known)


def binomial_tail(k, n, p) -> Column:
    """P(X >= k) for a binomial count: the incomplete beta function, which has no built-in, as an Arrow UDF over whole batches."""
    return _binomial_tail(_d(k), _d(n), _d(p))


def cumulative(values: DataFrame, keys: list[str], value: str, n: str = "n") -> DataFrame:
    """Count of the group strictly below each value, from one row per (group, value) with its count.

    A group is cut into ranges at approximate quantiles, so that no task has to order a whole group; the counts are
    exact whatever the cuts.
    """
    cuts = values.groupBy(*keys).agg(F.percentile_approx(value, [i / 32 for i in range(1, 32)], 400).alias("cuts"))
    x = values.join(cuts, keys).withColumn("part", F.size(F.filter("cuts", lambda c: c < F.col(value)))).drop("cuts")
    per = x.groupBy(*keys, "part").agg(F.sum(n).alias("part_n"))
    earlier = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("part_before", F.coalesce(F.sum("part_n").over(earlier), F.lit(0))).drop("part_n")
    inside = Window.partitionBy(*keys, "part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return x.join(per, [*keys, "part"]).withColumn(
        "below", F.col("part_before") + F.coalesce(F.sum(n).over(inside), F.lit(0))).drop("part", "part_before")


def percentile_rank(rows: DataFrame, keys: list[str], value: str, in_pool: Column, out: str = "percentile") -> DataFrame:
    """100 * (below + half of equal) / pool size, of every row against the pool members of its group.

    Rows outside the pool are placed in it too: they carry no weight.
    """
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count_if(in_pool).alias("n"))
    ranks = cumulative(counts, keys, value).select(*keys, value, "below", F.col("n").alias("equal"))
    size = counts.groupBy(*keys).agg(F.sum("n").alias("pool_n"))
    joined = rows.join(ranks, [*keys, value], "left").join(size, keys, "left")
    share = 100.0 * (F.col("below") + 0.5 * F.col("equal")) / F.nullif(F.col("pool_n"), F.lit(0))
    return joined.withColumn(out, share).drop("below", "equal")


def benjamini_hochberg(rows: DataFrame, keys: list[str], p: str, q: float, out: str = "passed") -> DataFrame:
    """Flag the tests of each group that pass at false-discovery rate q.

    All tests with the same p share the highest of their ranks, which is the rank that decides.
    """
    counts = rows.filter(F.col(p).isNotNull()).groupBy(*keys, p).agg(F.count("*").alias("n"))
    ranks = cumulative(counts, keys, p).withColumn("rank", F.col("below") + F.col("n"))
    m = counts.groupBy(*keys).agg(F.sum("n").alias("m"))
    edge = ranks.join(m, keys).filter(F.col(p) <= q * F.col("rank") / F.col("m")).groupBy(*keys).agg(F.max(p).alias("edge"))
    return rows.join(edge, keys, "left").withColumn(out, F.coalesce(F.col(p) <= F.col("edge"), F.lit(False))).drop("edge")
