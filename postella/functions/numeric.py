"""Numeric functions that Spark lacks, as Column expressions: log-factorials, hypergeometric tail, normal CDF and quantile."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# ln(n!) below 32, the coefficients of Abramowitz and Stegun 7.1.26, Winitzki's constant.
SMALL = [math.lgamma(n + 1) for n in range(32)]
ERF = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
ERF_P = 0.3275911
WINITZKI = 0.147


def log_factorials(*n: str) -> str:
    """SQL of the sum of ln(n!): Stirling's series from 32 on, where it is exact to doubles; a table below. No
    lookup join is needed, and the series stands in the plan once for all n."""
    small = ", ".join(f"{v!r}D" for v in SMALL)
    d = "cast(n as double)"
    series = f"{d} * ln({d}) - {d} + 0.5D * ln({2 * math.pi!r}D * {d}) + 1 / (12 * {d}) - 1 / (360 * {d} * {d} * {d}) + 1 / (1260 * {d} * {d} * {d} * {d} * {d})"
    one = f"case when n < 32 then element_at(array({small}), cast(n as int) + 1) else {series} end"
    return f"aggregate(array({', '.join(f'cast({x} as bigint)' for x in n)}), 0D, (a, n) -> a + {one})"


def with_hyper_tail(df: DataFrame, x: str, m: str, u: str, k: str, out: str) -> DataFrame:
    """Add P(X > x), X the hits among k draws without return from u cells of which m count; 1 - (1 - tail), so
    that what is below a double's resolution at one is 0. Terms further than 40 deviations from the mean are below
    the smallest double; the sum leaves them out, so its length grows with the root of k at most."""
    df = df.selectExpr("*", f"{k} * {m} / {u} __mean", f"greatest(0L, {k} - ({u} - {m})) __low", f"least({k}, {m}) __high")
    df = df.selectExpr("*", f"cast(ceil(40 * sqrt(greatest(__mean * (1 - {m} / {u}), 1D))) as bigint) + 50 __width", f"{log_factorials(m, f'{u} - {m}', k, f'{u} - {k}')} - {log_factorials(u)} __fixed")
    # the shorter side of the sum
    above = f"{x} >= __mean"
    df = df.selectExpr("*", f"if({above}, greatest({x} + 1, __low), greatest(__low, cast(floor(__mean) as bigint) - __width)) __first", f"if({above}, least(__high, {x} + __width), least({x}, __high)) __last")
    term = f"exp(__fixed - {log_factorials('i', f'{m} - i', f'{k} - i', f'{u} - {m} - {k} + i')})"
    df = df.selectExpr("*", f"if(__first > __last, 0D, aggregate(sequence(__first, greatest(__first, __last)), 0D, (s, i) -> s + {term})) __sum")
    tail = f"greatest(0D, least(1D, if({above}, 1 - (1 - __sum), 1 - __sum)))"
    return df.selectExpr("*", f"{tail} {out}").drop("__mean", "__low", "__high", "__width", "__fixed", "__first", "__last", "__sum")


def holm(df: DataFrame, p: str, n: Column, by: list[str] = (), out: str | None = None) -> DataFrame:
    """Adjust p by Holm's step-down for n tests. One row per group, so the window is as small as their number."""
    ranked = Window.partitionBy(*by).orderBy(F.col(p))
    df = df.withColumn("__i", F.row_number().over(ranked)).withColumn("__q", (n - F.col("__i") + 1) * F.col(p))
    run = Window.partitionBy(*by).orderBy("__i").rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out or p, F.least(F.lit(1.0), F.max("__q").over(run))).drop("__i", "__q")


def normal_cdf(x: Column, mu: Column, sigma: Column) -> Column:
    """Phi((x - mu) / sigma) to 1e-7; a half where sigma is 0."""
    z = (x - mu) / sigma / math.sqrt(2)
    t = 1 / (1 + ERF_P * F.abs(z))
    poly = F.lit(0.0)
    for a in reversed(ERF):
        poly = t * (a + poly)
    erf = F.signum(z) * (1 - poly * F.exp(-z * z))
    return F.when(sigma == 0, F.lit(0.5)).otherwise(0.5 * (1 + erf))


def inverse_erf(x: Column) -> Column:
    """Winitzki's approximation."""
    ln = F.log(1 - x * x)
    b = 2 / (math.pi * WINITZKI) + ln / 2
    return F.signum(x) * F.sqrt(F.sqrt(b * b - ln / WINITZKI) - b)


def log_normal_quantile(p: Column, mu: Column, sigma: Column) -> Column:
    """The value v with log(1 + v) at the p-quantile of N(mu, sigma)."""
    return F.exp(inverse_erf(2 * p - 1) * math.sqrt(2) * sigma + mu) - 1
