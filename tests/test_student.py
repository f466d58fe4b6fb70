"""Student's t quantiles against closed forms and printed tables."""

import math

import pytest
from pyspark.sql import functions as F

from fleetlens.functions import student
from fleetlens.operators.quality import mean_interval


def share_within(t, n):
    """P(|T| < t) by the finite trigonometric series for whole degrees of freedom."""
    angle = math.atan(t / math.sqrt(n))
    c, s = math.cos(angle), math.sin(angle)
    if n == 1:
        return 2 * angle / math.pi
    term = total = c if n % 2 else 1.0
    for k in range(3 if n % 2 else 2, n - 1, 2):
        term *= (k - 1) / k * c * c
        total += term
    return 2 / math.pi * (angle + s * total) if n % 2 else s * total


@pytest.mark.parametrize("p", [0.9, 0.975, 0.9975])
def test_quantiles_hold_the_probability(p):
    for n in range(1, 201):
        low, high = 0.0, 1e4
        while high - low > 1e-12 * max(1, high):
            m = (low + high) / 2
            low, high = (m, high) if share_within(m, n) < 2 * p - 1 else (low, m)
        assert student.t_quantile(p, n) == pytest.approx(low, rel=1e-9)


@pytest.mark.parametrize("n,want", [(1, 127.321), (2, 14.089), (3, 7.453), (4, 5.598), (5, 4.773), (10, 3.581), (30, 3.030), (200, 2.839), (1000, 2.813)])
def test_quantile_column(spark, n, want):
    got = spark.range(1).select(student.t_column(0.9975, F.lit(n)), student.t_column(0.9975, F.lit(0))).first()
    assert got[0] == pytest.approx(want, abs=6e-4) and got[1] is None


def test_table_and_expansion_meet(spark):
    at = [r[0] for r in spark.range(195, 206).select(student.t_column(0.9975, F.col("id"))).collect()]
    steps = [a - b for a, b in zip(at, at[1:])]
    assert all(0 < s < 2e-4 for s in steps) and max(steps) < 1.2 * min(steps)
    assert student.t_quantile(0.9975, 201) == pytest.approx(at[6], rel=1e-9)


def test_intervals_of_groups_and_of_all(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0)], "k string, x double")
    got = {r.k: (r.n, r.mean, r.half) for r in mean_interval(df, ["k"], F.col("x")).collect()}
    assert got == {"a": (2, 2.0, round(127.3213364689 * math.sqrt(2) / math.sqrt(2), 3)), "b": (1, 5.0, None), None: (3, 3.0, round(14.0890472756 * 2 / math.sqrt(3), 3))}
