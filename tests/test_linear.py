"""Series of one vehicle that grow, parsers of dictionary and dump lines, and small helpers of the sources."""

import time

import pytest
from pyspark.sql import functions as F

from fleetlens.operators import quality, sessions, signals, timeseries
from fleetlens.sources import tables, telemetry


@pytest.fixture(scope="module")
def long(spark):
    n = F.col("id")
    some = lambda m, v: F.when(n % m == 0, v.cast("double"))
    df = spark.range(200_000).select(F.lit(1).alias("id"), n.alias("t_sec"), n.alias("sequence"), some(1000, n / 100).alias("odo"), some(500, n % 90).alias("amps"), (n % 60).cast("double").alias("speed"), (n % 80).cast("double").alias("tmax"), F.when(n % 5000 < 100, "CHARGING_ACTIVE").otherwise("DISCHARGING").alias("mode"))
    return df.repartition(4)


@pytest.mark.parametrize("name,f", [
    ("fill", lambda df: timeseries.fill_forward_back(df, ["odo"])), ("interpolate", lambda df: timeseries.interpolate(df, "odo", "time")), ("odo", timeseries.impute_odo_speed),
    ("current", timeseries.null_out_current), ("segments", sessions.day_segments), ("cooling", sessions.cooling_response),
])
def test_time_grows_with_the_rows_of_a_vehicle(long, name, f):
    began = time.time()
    assert f(long).agg(F.count("*"), F.sum(F.xxhash64(*f(long).columns).cast("decimal(38,0)"))).first()[0] > 0
    # frames that shrink row by row would take a quarter of an hour
    assert time.time() - began < 40


def test_signal_lines(spark):
    lines = [
        ' SG_ Pack_Volt : 0|16@1+ (0.1,0) [0|1000] "V" Vector__XXX', "SG_ A__b m3 : 8|8@1- (1,-40) [ -40 | 2.1e2 ] \"C: x\" N", "SG_ Bare : [1|2]", "BO_ 12 Frame: 8 N", "SG_ none", 'CM_ SG_ 12 Pack_Volt "[3|4]";', "SG_ odd : [x|1]",
    ]
    df = spark.createDataFrame(list(enumerate(lines)), "n long, value string")
    got = {r.n: (r.s.signal, r.s.lo, r.s.hi) for r in df.select("n", signals.signal_of(F.col("value")).alias("s")).collect()}
    none = (None, None, None)
    assert got == {0: ("Pack_Volt", 0.0, 1000.0), 1: ("A__b", -40.0, 210.0), 2: ("Bare", 1.0, 2.0), 3: none, 4: none, 5: none, 6: ("odd", None, 1.0)}
    assert {(r.signal, r.lo, r.hi) for r in signals.ranges_of_lines(df).collect()} == {("pack_volt", 0.0, 1000.0), ("a_b", -40.0, 210.0), ("bare", 1.0, 2.0)}


def test_copy_headers(spark):
    lines = ["COPY public.trips (id, name) FROM stdin;", 'COPY "My ""own"" table" ("a b", c, "x(y") FROM stdin;', "COPY t (a) TO stdout;", "COPY t FROM stdin;", "1\tCOPY", "COPY s.t (a) FROM stdin;"]
    df = spark.createDataFrame(list(enumerate(lines)), "n long, value string")
    got = {r.n: r.h and (r.h.table, list(r.h.names)) for r in df.select("n", tables.copy_header(F.col("value")).alias("h")).collect()}
    assert got == {0: ("trips", ["id", "name"]), 1: ('My "own" table', ["a b", "c", "x(y"]), 2: None, 3: None, 4: None, 5: ("t", ["a"])}


def test_columns_and_stages(spark, tmp_path):
    df = spark.createDataFrame([(1, 2, 3)], "b int, pack_temperature1 int, a int")
    assert telemetry.reorder_columns(df, ["a", "z", "b"]).columns == ["a", "b", "pack_temperature1"]
    assert telemetry.regex_columns(df, "^pack_temperature", ("a",)).columns == ["pack_temperature1", "a"]
    path = str(tmp_path / "stage")
    assert telemetry.stage_checkpoint(df, path, "day 1").collect() == df.collect()
    # a stage that is done isn't run again
    assert telemetry.stage_checkpoint(df.where("a = 0"), path, "day 1").collect() == df.collect()
    # another input has another key
    assert telemetry.stage_checkpoint(df.where("a = 0"), path, "day 2").count() == 0


def test_local_days_reach_the_scan(spark, data):
    df = telemetry.scan_local_day(spark.read.parquet(f"{data}/events.parquet"), "2024-01-10")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in plan and "LessThan(ts" in plan
