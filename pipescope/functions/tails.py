"""Tail probabilities of the usual test distributions, as vectorised functions on aggregated rows.

Spark SQL has no error function or incomplete beta/gamma. Tests produce one row per comparison, so
these run on a handful of rows after all data has been reduced inside Spark.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_STEPS, _TINY = 500, 1e-300


def normal_two_sided(z: float) -> float:
    return min(1.0, math.erfc(abs(z) / math.sqrt(2.0)))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > _TINY else _TINY)
    out = d
    for m in range(1, _STEPS):
        for numerator in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + numerator * d
            d = 1.0 / (d if abs(d) > _TINY else _TINY)
            c = 1.0 + numerator / c
            c = c if abs(c) > _TINY else _TINY
            out *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return out


def incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def student_two_sided(t: float, df: float) -> float:
    return incomplete_beta(df / 2.0, 0.5, df / (df + t * t))


def chi_square_upper(x: float, df: float) -> float:
    """Upper regularised gamma at (df/2, x/2): series below, continued fraction above the mean."""
    a, x = df / 2.0, x / 2.0
    if x <= 0.0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1.0:
        term = total = 1.0 / a
        for n in range(1, _STEPS * 20):
            term *= x / (a + n)
            total += term
            if term < total * 1e-16:
                break
        return max(0.0, 1.0 - total * front)
    b = x + 1.0 - a
    c, d = 1.0 / _TINY, 1.0 / b
    out = d
    for i in range(1, _STEPS * 20):
        numerator = -i * (i - a)
        b += 2.0
        d = numerator * d + b
        d = 1.0 / (d if abs(d) > _TINY else _TINY)
        c = b + numerator / c
        c = c if abs(c) > _TINY else _TINY
        out *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return front * out


def rank_sum_two_sided(u: float, n1: float, n2: float) -> float:
    """Exact two-sided p of the Mann-Whitney U of untied samples.

    The number of orders with each value of U are the coefficients of a Gaussian binomial: a product of n1 factors
    (1 - q^(n2 + i)) / (1 - q^i), kept as whole numbers up to the smaller of U and n1 * n2 - U.
    """
    n1, n2 = sorted((int(n1), int(n2)))
    low = int(min(u, n1 * n2 - u))
    orders = np.zeros(low + 1, object)
    orders[0] = 1
    for i in range(1, n1 + 1):
        if n2 + i <= low:
            orders[n2 + i:] = orders[n2 + i:] - orders[:low + 1 - n2 - i]
        for first in range(min(i, low + 1)):
            orders[first::i] = np.add.accumulate(orders[first::i])
    return min(1.0, 2 * int(orders.sum()) / math.comb(n1 + n2, n1))


def _rowwise(fn, *columns: pd.Series) -> pd.Series:
    def one(row):
        return None if any(v is None or math.isnan(v) for v in row) else fn(*row)

    return pd.Series([one(row) for row in zip(*columns)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def _normal_p(z: pd.Series) -> pd.Series:
    return _rowwise(normal_two_sided, z)


@F.pandas_udf(T.DoubleType())
def _student_p(t: pd.Series, df: pd.Series) -> pd.Series:
    return _rowwise(student_two_sided, t, df)


@F.pandas_udf(T.DoubleType())
def _chi_square_p(x: pd.Series, df: pd.Series) -> pd.Series:
    return _rowwise(chi_square_upper, x, df)


@F.pandas_udf(T.DoubleType())
def _rank_sum_p(u: pd.Series, n1: pd.Series, n2: pd.Series) -> pd.Series:
    return _rowwise(rank_sum_two_sided, u, n1, n2)


def rank_sum_p(u: Column, n1: Column, n2: Column) -> Column:
    """Exact two-sided p-value of an untied rank-sum statistic; NULL for a NULL one."""
    return _rank_sum_p(u.cast("double"), n1.cast("double"), n2.cast("double"))


def signed_rank_p(twice_ranks: Column, statistic: Column) -> Column:
    """Exact two-sided p-value of a signed-rank statistic (the smaller rank sum), from twice the ranks as whole numbers.

    Under random signs each rank is added or not, so the law of the sum is folded rank by rank, up to the statistic; ties
    (half ranks) and ranks that zeros have raised are taken as they are.
    """
    upto = F.sequence(F.lit(0), F.round(2 * statistic).cast("int"))
    start = F.transform(upto, lambda i: F.when(i == 0, 1.0).otherwise(0.0))
    law = F.aggregate(twice_ranks, start, lambda law, rank: F.transform(
        law, lambda p, i: (p + F.when(i >= rank, F.get(law, i - rank)).otherwise(0.0)) / 2))
    return F.least(F.lit(1.0), 2 * F.aggregate(law, F.lit(0.0), lambda total, p: total + p))


def normal_p(z: Column) -> Column:
    """Two-sided p-value of a standard normal statistic."""
    return _normal_p(z.cast("double"))


def student_p(t: Column, df: Column) -> Column:
    """Two-sided p-value of a t statistic."""
    return _student_p(t.cast("double"), df.cast("double"))


def chi_square_p(x: Column, df: Column) -> Column:
    """Upper tail of a chi-square statistic."""
    return _chi_square_p(x.cast("double"), df.cast("double"))
