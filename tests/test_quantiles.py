"""Distributed quantiles against sorted lists."""

import math
import random

import pytest
from pyspark.sql import functions as F

from fleetlens.operators.quantiles import approximate_quantiles, quantiles, with_quantiles

P = [0.0, 0.01, 0.25, 0.5, 0.95, 0.99, 1.0]


def interpolated(values, p):
    values = sorted(values)
    at = p * (len(values) - 1)
    low, high = values[math.floor(at)], values[math.ceil(at)]
    return low + (high - low) * (at - math.floor(at))


@pytest.fixture(scope="module")
def groups():
    rng = random.Random(3)
    return {
        "even": [rng.uniform(-5, 5) for _ in range(3000)], "one value": [7.0] * 2000, "two": [1.0] * 1999 + [2.0], "single": [4.5], "skewed": [math.exp(rng.gauss(0, 4)) for _ in range(2000)] + [0.0] * 3000,
        None: [float(i % 13) for i in range(500)],
    }


@pytest.fixture(scope="module")
def df(spark, groups):
    rows = [(k, v) for k, values in groups.items() for v in values] + [("even", None)] * 50 + [("nothing", None)] * 3
    return spark.createDataFrame(rows, "k string, x double").repartition(4)


@pytest.mark.parametrize("buckets", [2, 64])
def test_exact(df, groups, buckets):
    got = {r.k: r.q for r in quantiles(df, ["k"], F.col("x"), P, buckets).collect()}
    assert set(got) == set(groups)
    for k, values in groups.items():
        assert got[k] == pytest.approx([interpolated(values, p) for p in P], rel=1e-12, abs=1e-12)


def test_whole_column(df, groups):
    (r,) = quantiles(df, [], F.col("x"), P).collect()
    assert list(r.q) == pytest.approx([interpolated([v for x in groups.values() for v in x], p) for p in P])


def test_buckets_are_small(spark):
    # the largest task's share of a column of distinct values
    df = spark.range(10_000).select(F.lit("k").alias("k"), (F.col("id") * 7919 % 10_007).cast("double").alias("x"))
    plan = quantiles(df, ["k"], F.col("x"), [0.5])._jdf.queryExecution().toString()
    assert "percentile(" not in plan and "__bucket" in plan


def test_groups_without_values_stay(df):
    out = with_quantiles(df.groupBy("k").agg(F.count("*").alias("n")), df, ["k"], F.col("x"), [0.5])
    got = {r.k: (r.n, r.q) for r in out.collect()}
    assert got["nothing"] == (3, None) and got["single"] == (1, [4.5]) and got[None][1] == [6.0]


def test_approximate(df, groups):
    for r in approximate_quantiles(df, ["k"], F.col("x"), [0.25, 0.5, 0.95]).collect():
        values = sorted(groups[r.k])
        for p, v in zip([0.25, 0.5, 0.95], r.q):
            rank = [sum(x < v for x in values), sum(x <= v for x in values)]
            assert rank[0] - 0.01 * len(values) - 1 <= p * len(values) <= rank[1] + 0.01 * len(values) + 1
