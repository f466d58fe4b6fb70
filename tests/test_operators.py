"""Operators on small hand-made frames."""

import pytest
from pyspark.sql import functions as F

from fleetlens.functions import expressions as X
from fleetlens.operators import sessions as E
from fleetlens.operators import timeseries as T


def frame(spark, rows, columns):
    return spark.createDataFrame(rows, columns)


def test_fills_stay_inside_a_vehicle(spark):
    df = frame(spark, [("a", 1, 0, None), ("a", 2, 10, 5.0), ("a", 3, 20, None), ("b", 4, 0, None), ("b", 5, 10, 7.0)], "id string, sequence long, t_sec long, x double")
    got = {r.sequence: r.x for r in T.fill_forward_back(df, ["x"]).collect()}
    assert got == {1: 5.0, 2: 5.0, 3: 5.0, 4: 7.0, 5: 7.0}


def test_interpolation_limit_leaves_the_middle(spark):
    rows = [("a", i, i, 0.0 if i == 0 else 6.0 if i == 6 else None) for i in range(7)]
    df = frame(spark, rows, "id string, sequence long, t_sec long, x double")
    got = {r.sequence: r.x for r in T.interpolate(df, "x", limit=2).collect()}
    assert got[3] is None and got[2] == pytest.approx(2.0) and got[4] == pytest.approx(4.0)


def test_odometer_by_speed_is_clamped(spark):
    rows = [("a", 0, 0, 10.0, 0.0), ("a", 1, 1, None, 3600.0), ("a", 2, 2, None, 3600.0), ("a", 3, 3, 11.5, 0.0), ("a", 4, 4, None, 3600.0)]
    df = frame(spark, rows, "id string, sequence long, t_sec long, odo double, speed double")
    assert [r.odo for r in T.impute_odo_speed(df).orderBy("sequence").collect()] == [10.0, 11.0, 11.5, 11.5, 11.5]


def test_islands_count_is_changes_plus_one(spark):
    df = frame(spark, [("a", i, i, k) for i, k in enumerate([1, 1, None, None, 2, 1])], "id string, sequence long, t_sec long, k int")
    assert [r.island for r in T.islands(df, F.col("k")).orderBy("sequence").collect()] == [1, 1, 2, 2, 3, 4]


def test_charging_pauses_of_14_and_16_minutes(spark):
    rows, t = [], 0
    for mode, length in (("CHARGING_ACTIVE", 600), ("DISCHARGING_IDLE", 840), ("CHARGING_ACTIVE", 600), ("DISCHARGING_IDLE", 960), ("CHARGING_ACTIVE", 600)):
        rows += [("a", s, s, mode) for s in range(t, t + length, 60)]
        t += length
    got = E.charging_envelopes(frame(spark, rows, "id string, sequence long, t_sec long, mode string"), merge_min=15).count()
    assert got == 2


def test_buckets_are_right_closed(spark):
    df = frame(spark, [(28.0,), (28.1,), (40.0,), (40.1,), (None,)], "tmax double")
    got = [r[0] for r in df.select(X.bucket(F.col("tmax"), X.TEMP_EDGES, X.TEMP_LABELS)).collect()]
    assert got == ["<28", "28-32", "35-40", ">40", None]


def test_flag_words(spark):
    df = frame(spark, [("1",), (" Yes ",), ("0",), (None,), ("1.0",), ("ready",)], "x string")
    assert [r[0] for r in df.select(X.flag("x")).collect()] == [True, True, False, False, True, False]


def test_hms_passes_a_day(spark):
    assert [r[0] for r in frame(spark, [(90061.0,), (None,)], "s double").select(X.hms(F.col("s"))).collect()] == ["25:01:01", None]


def test_alert_period(spark):
    rows = [("a", i, 60 * i, 36.0 if 5 <= i < 15 else 30.0, 1, 0) for i in range(30)]
    df = frame(spark, rows, "id string, sequence long, t_sec long, tmax double, ready int, gun int")
    (got,) = E.alert_periods(df, F.col("tmax") > 35).collect()
    assert got.end - got.start == 540 and got.kind == "motion"
