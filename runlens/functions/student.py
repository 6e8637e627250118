"""Student-t quantiles as a Column: a table for few degrees of freedom, a series above."""

from __future__ import annotations

import math
from functools import lru_cache
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

TABLE_SIZE = 200


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / (c if abs(c) > tiny else tiny)
            h *= d * c
        if abs(d * c - 1.0) < 1e-16:
            break
    return h


def t_upper_tail(t: float, df: float) -> float:
    """P(T > t) for t > 0."""
    x = df / (df + t * t)
    a, b = df / 2.0, 0.5
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1.0) / (a + b + 2.0):
        return 0.5 * front * _beta_fraction(a, b, x) / a
    return 0.5 * (1.0 - front * _beta_fraction(b, a, 1.0 - x) / b)


def t_series_coefficients(p: float) -> list[float]:
    """Coefficients of the expansion of the t quantile in powers of 1/df."""
    z = NormalDist().inv_cdf(p)
    return [
        z,
        (z**3 + z) / 4,
        (5 * z**5 + 16 * z**3 + 3 * z) / 96,
        (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384,
        (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160,
    ]


@lru_cache(maxsize=None)
def t_table(p: float = 0.975, size: int = TABLE_SIZE) -> tuple[float, ...]:
    """Quantiles for df = 1..size by bisection on the upper tail, 12 decimals."""
    out = []
    for df in range(1, size + 1):
        lo, hi = 0.0, 2.0
        while t_upper_tail(hi, df) > 1.0 - p:
            hi *= 2
        for _ in range(200):
            mid = (lo + hi) / 2
            if mid in (lo, hi):
                break
            lo, hi = (mid, hi) if t_upper_tail(mid, df) > 1.0 - p else (lo, mid)
        out.append(round((lo + hi) / 2, 12))
    return tuple(out)


def t_quantile(df: Column, p: float = 0.975) -> Column:
    """t quantile for an integer df column; NULL below one degree of freedom."""
    table = F.array(*[F.lit(v) for v in t_table(p)])
    x = df.cast("double")
    series = F.lit(0.0)
    for c in reversed(t_series_coefficients(p)):
        series = series / x + F.lit(c)
    return F.when(df.between(1, TABLE_SIZE), F.try_element_at(table, df.cast("int"))).when(
        df > TABLE_SIZE, series
    )
