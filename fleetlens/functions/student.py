"""Quantiles of Student's t distribution."""

from __future__ import annotations

import math
from functools import lru_cache
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Degrees of freedom whose quantiles stand in a table; beyond, the expansion in powers of 1 / df is as good as a double.
TABLE = 200


def beta_share(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function, by its continued fraction (modified Lentz steps)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_share(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    value, c, d = 1.0, 1.0, 0.0
    for i in range(1000):
        m = i // 2
        term = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + term * d or tiny)
        c = 1 + term / c or tiny
        value *= c * d
        if i and abs(c * d - 1) < 1e-16:
            break
    return front * (value - 1)


def upper_tail(t: float, df: float) -> float:
    """P(T > t) for t >= 0."""
    return beta_share(df / (df + t * t), df / 2, 0.5) / 2


@lru_cache(4096)
def t_quantile(p: float, df: int) -> float:
    """The t that T stays below with probability p (above one half): its tail is bracketed, then halved until doubles end."""
    if df < 1 or not 0.5 < p < 1:
        raise ValueError("degrees of freedom from 1, probabilities between 1/2 and 1")
    low, high = 0.0, 1.0
    while upper_tail(high, df) > 1 - p:
        low, high = high, high * 2
    while (middle := (low + high) / 2) not in (low, high):
        low, high = (middle, high) if upper_tail(middle, df) > 1 - p else (low, middle)
    return high


def t_column(p: float, df: Column) -> Column:
    """The quantile for a column of degrees of freedom; null below 1."""
    z = NormalDist().inv_cdf(p)
    terms = (
        (z**3 + z) / 4,
        (5 * z**5 + 16 * z**3 + 3 * z) / 96,
        (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384,
        (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160,
    )
    beyond = sum((F.lit(g) / F.pow(df.cast("double"), F.lit(i)) for i, g in enumerate(terms, 1)), F.lit(z))
    small = F.get(F.array(*(F.lit(t_quantile(p, n)) for n in range(1, TABLE + 1))), (df - 1).cast("int"))
    return F.when(df <= TABLE, F.when(df >= 1, small)).otherwise(beyond)
