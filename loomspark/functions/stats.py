"""Statistics as column expressions over counts and moments. Every division by zero gives null."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def laplace_confidence(high: Column, low: Column) -> Column:
    """Of the majority direction; one half without support."""
    return (F.greatest(high, low) + 1.0) / (high + low + 2.0)


def wilson(k: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Score interval of k of n, within 0 and 1; null for n = 0."""
    p = ratio(k, n)
    mid = p + F.try_divide(F.lit(z * z / 2), n)
    half = z * F.sqrt(F.try_divide(p * (1 - p), n) + F.try_divide(F.lit(z * z / 4), n * n))
    whole = 1 + F.try_divide(F.lit(z * z), n)
    return F.when(n > 0, F.greatest(F.lit(0.0), (mid - half) / whole)), F.when(n > 0, F.least(F.lit(1.0), (mid + half) / whole))


def phi(n11: Column, n10: Column, n01: Column, n00: Column) -> Column:
    n11, n10, n01, n00 = (x.cast("double") for x in (n11, n10, n01, n00))
    return F.try_divide(n11 * n00 - n10 * n01, F.sqrt((n11 + n10) * (n01 + n00) * (n11 + n01) * (n10 + n00)))


def jaccard(n11: Column, n10: Column, n01: Column) -> Column:
    return ratio(n11, n11 + n10 + n01)


def lift(n11: Column, n10: Column, n01: Column, n00: Column) -> Column:
    n = n11 + n10 + n01 + n00
    return F.try_divide(n11.cast("double") * n, (n11 + n10).cast("double") * (n11 + n01))


def odds_ratio(n11: Column, n10: Column, n01: Column, n00: Column) -> Column:
    """With a half added to each cell."""
    a, b, c, d = (x + 0.5 for x in (n11, n10, n01, n00))
    return a * d / (b * c)


def log_loss(y: Column, p: Column, floor: float = 1e-9) -> Column:
    q = F.greatest(F.lit(floor), F.least(F.lit(1 - floor), p))
    return -(y * F.ln(q) + (1 - y) * F.ln(1 - q))


def pearson(x: Column, y: Column) -> Column:
    """Aggregate. From moments, so that a constant gives null."""
    cov = F.avg(x * y) - F.avg(x) * F.avg(y)
    return F.try_divide(cov, F.stddev_pop(x) * F.stddev_pop(y))


def binomial_survival(k: Column, n: Column, p: Column) -> Column:
    """P(X >= k), summed in log space; for n in the thousands at most."""
    term = lambda j: F.exp(_log_choose(n, j) + j * F.ln(p) + (n - j) * F.ln(1 - p))
    tail = F.aggregate(F.when(k <= n, F.sequence(k, n)).otherwise(F.array().cast("array<int>")), F.lit(0.0), lambda s, j: s + term(j.cast("double")))
    return F.when(k <= 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), tail))


def _log_choose(n: Column, k: Column) -> Column:
    """ln of n over k as a sum of logs."""
    steps = F.when(k >= 1, F.sequence(F.lit(1), k.cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, F.lit(0.0), lambda s, i: s + F.ln((n - k + i) / i))


def mode_order(n: Column, value: Column) -> list[Column]:
    """The order whose first row is the mode: most frequent, then smallest."""
    return [n.desc(), value.asc()]


def _upper_gamma(a: float, x: float) -> float:
    """The regularised upper incomplete gamma function: by its power series below the bend, by a fraction above it."""
    if x <= 0:
        return 1.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while term > total * 1e-16:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - scale * total)
    value, n = 0.0, int(60 + 20 * math.sqrt(a) + 400 / x)
    for k in range(n, 0, -1):  # from the innermost fraction outwards
        value = k * (k - a) / (x + 2 * k + 1 - a - value)
    return scale / (x + 1 - a - value)


def _beta(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function, by its continued fraction from the innermost part outwards."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta(1 - x, b, a)
    value = 0.0
    for m in range(int(200 + 5 * math.sqrt(max(a, b))), 0, -1):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        value = even / (1 + odd / (1 + value))
    first = -(a + b) * x / (a + 1)
    front = math.exp(a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) / a
    return front / (1 + first / (1 + value))


@F.pandas_udf(T.DoubleType())
def chi_square_tail(x: pd.Series, df: pd.Series) -> pd.Series:
    """P(X >= x) of a chi-square variable; for summary rows, not for data."""
    return pd.Series([None if pd.isna(v) or not d > 0 else _upper_gamma(d / 2, v / 2) for v, d in zip(x, df, strict=True)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def f_tail(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    """P(X >= f) of an F variable; for summary rows, not for data."""
    return pd.Series([None if pd.isna(v) or not (a > 0 and b > 0) else _beta(b / (b + a * v), b / 2, a / 2) for v, a, b in zip(f, d1, d2, strict=True)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def binomial_tail(k: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
    """P(X >= k) of n draws, by the incomplete beta function, for any n; for summary rows, not for data."""
    return pd.Series([1.0 if a <= 0 or q >= 1 else 0.0 if a > m else _beta(q, a, m - a + 1) for a, m, q in zip(k, n, p, strict=True)], dtype="float64")
