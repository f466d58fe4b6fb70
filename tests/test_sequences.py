"""Sequential operators, frames, scans and streaming jobs on small inputs."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.functions import expressions as X
from fleetlens.operators import enrich as N
from fleetlens.operators import quality as Q
from fleetlens.operators import sweeps as W
from fleetlens.operators.covers import covers
from fleetlens.sources import dialects
from fleetlens.sources import telemetry as S
from fleetlens.streaming import jobs


def test_blips_see_their_own_changes(spark):
    modes = ["CHARGING_ACTIVE", "DISCHARGING_IDLE", "CHARGING_ACTIVE", "DISCHARGING_IDLE", "CHARGING_ACTIVE"]
    df = spark.createDataFrame([("a", i, 30 * i, m) for i, m in enumerate(modes)], "id string, sequence long, t_sec long, mode string")
    assert {r.smoothed for r in W.micro_blip_smooth(df).collect()} == {"CHARGING_ACTIVE"}
    slow = df.withColumn("t_sec", F.when(F.col("sequence") >= 3, F.col("t_sec") + 60).otherwise(F.col("t_sec")))
    assert [r.smoothed for r in W.micro_blip_smooth(slow).orderBy("sequence").collect()][3] == "DISCHARGING_IDLE"


def test_sweeps_reset(spark):
    rows = [("a", i, 10 * i, s) for i, s in enumerate([0, 1, 1, None, 2, 0, 2, 1, 0])]
    df = spark.createDataFrame(rows, "id string, sequence long, t_sec long, sensor int")
    got = [(r.cycle, r.start, r.end, r.rows, r.since) for r in W.sweep_cycles(df, 3).orderBy("cycle").collect()]
    assert got == [(1, 0, 40, 5, None), (2, 50, 70, 3, 10)]


def test_brake_to_stop_does_not_overlap(spark):
    rows = [("a", i, t, v, b) for i, (t, v, b) in enumerate([(0, 50.0, 10), (10, 30.0, 10), (20, 0.0, 0), (30, 40.0, 5), (100, 0.0, 0)])]
    df = spark.createDataFrame(rows, "id string, sequence long, t_sec long, speed double, brake long")
    assert [(r.start, r.stop) for r in W.brake_to_stop(df).collect()] == [(0, 20)]


def walked(rows, n):
    """Covers of one vehicle's (t, items), row by row."""
    out, seen, start, count, before = [], set(), None, 0, None
    for t, items in rows:
        start = t if start is None else start
        count += 1
        seen |= {i for i in items if i is not None and 0 <= i < n}
        if len(seen) == n:
            out.append((len(out) + 1, start, t, count, None if before is None else start - before))
            seen, start, count, before = set(), None, 0, t
    return out


@pytest.mark.parametrize("chunk_sec", [1, 7, 40, 10_000])
def test_covers_over_chunks(spark, chunk_sec):
    import random

    rng = random.Random(7)
    rows = {}
    for v, n, spread in (("a", 400, 3), ("b", 300, 1), ("c", 5, 1), ("d", 1, 1)):
        t, rows[v] = 0, []
        for _ in range(n):
            # ties, rests, numbers outside, and a sensor that is rarely seen
            t += rng.choice([0, 1, spread, 30 if rng.random() < 0.05 else 1])
            rows[v].append((t, [rng.choice([0, 1, 2, 0, 1, 9, -1, None] + [3] * (rng.random() < 0.4)) for _ in range(rng.choice([0, 1, 1, 2]))]))
    df = spark.createDataFrame([(v, t, i, items) for v, x in rows.items() for i, (t, items) in enumerate(x)], "id string, t_sec long, sequence long, items array<int>")
    found, _ = covers(df, F.col("items"), 4, chunk_sec=chunk_sec)
    got = {}
    for r in found.orderBy("id", "cycle").collect():
        got.setdefault(r.id, []).append((r.cycle, r.start, r.end, r.rows, r.since))
    assert got == {v: w for v, x in rows.items() if (w := walked(x, 4))}
    assert len(got["a"]) > 5


def test_a_vehicle_is_many_groups(spark):
    df = spark.createDataFrame([("a", 10 * i, i, [i % 3]) for i in range(100)], "id string, t_sec long, sequence long, items array<int>")
    _, rows = covers(df, F.col("items"), 3, chunk_sec=100)
    assert rows.groupBy("id", "chunk").count().agg(F.max("count"), F.count("*")).first() == (10, 10)


@pytest.mark.parametrize("seed", range(4))
def test_blips_as_a_walk_would(spark, seed):
    import random

    rng = random.Random(seed)
    t, rows = 0, []
    for i in range(300):
        t += rng.choice([0, 10, 30, 60, 61, 200])
        rows.append((t, i, rng.choice(["CHARGING_ACTIVE", "CHARGING_IDLE", "DISCHARGING_ACTIVE", "DISCHARGING_IDLE", *(["OFF", None] if seed % 2 and rng.random() < 0.2 else [])])))
    modes, domain = [m for _, _, m in rows], [m.split("_")[0] if m and m != "OFF" else None for _, _, m in rows]
    for i in range(1, len(rows) - 1):
        if domain[i] and domain[i - 1] and domain[i - 1] == domain[i + 1] != domain[i] and rows[i][0] - rows[i - 1][0] <= 60:
            domain[i] = domain[i - 1]
            modes[i] = f"{domain[i]}_ACTIVE"
    df = spark.createDataFrame([("a", *r) for r in rows] + [("b", *r) for r in rows[::2]], "id string, t_sec long, sequence long, mode string")
    got = W.micro_blip_smooth(df)
    assert "Python" not in plan(got) and "Pandas" not in plan(got)
    assert [r.smoothed for r in got.where("id = 'a'").orderBy("sequence").collect()] == modes


@pytest.mark.parametrize("seed", range(3))
def test_stops_as_a_walk_would(spark, seed):
    import random

    rng = random.Random(seed)
    t, rows = 0, []
    for i in range(300):
        t += rng.choice([0, 5, 20, 70])
        rows.append((t, i, rng.choice([0.0, 0.05, 0.5, 20.0, 40.0, None, float("nan")]), rng.choice([0, 1, None])))
    want, i = [], 0
    while i < len(rows):
        t, _, v, b = rows[i]
        stop = next((j for j in range(i + 1, len(rows)) if rows[j][2] is not None and rows[j][2] <= 0.1 and rows[j][0] - t <= 60), None) if b and v is not None and v > 1 else None
        if stop is None:
            i += 1
        else:
            want.append((t, rows[stop][0], v))
            i = stop + 1
    df = spark.createDataFrame([("a", *r) for r in rows], "id string, t_sec long, sequence long, speed double, brake long")
    got = W.brake_to_stop(df)
    assert "Python" not in plan(got) and "Pandas" not in plan(got)
    assert sorted((r.start, r.stop, r.start_speed) for r in got.collect()) == sorted(want)
    assert len(want) > 5


def plan(df):
    return df._jdf.queryExecution().toString()


def test_presses_too_old_and_presses_behind_a_stop(spark):
    # of the first three presses the first is too old at the standstill; the one at 70 comes behind it
    rows = [(0, 50.0, 1), (30, 40.0, 1), (40, 30.0, 1), (65, 0.0, 1), (70, 20.0, 1), (75, None, 0), (80, 0.05, 0), (85, 0.0, 0)]
    df = spark.createDataFrame([(v, i, t, x, b) for v in "ab" for i, (t, x, b) in enumerate(rows)], "id string, sequence long, t_sec long, speed double, brake long")
    assert sorted(tuple(r) for r in W.brake_to_stop(df).collect()) == [(v, *x) for v in "ab" for x in ((30, 65, 40.0), (70, 80, 20.0))]


def test_deadreckoning_between_fixes(spark):
    rows = [(None, None), (0.0, 0.0), (None, None), (None, 5.0), (None, None), (0.0, 1.0), (None, None)]
    df = spark.createDataFrame([(v, i, 10 * i, 36.0, *x) for v in "ab" for i, x in enumerate(rows)], "id string, sequence long, t_sec long, speed double, lat double, lon double")
    got = N.gps_deadreckon(df)
    assert "Python" not in plan(got) and "Pandas" not in plan(got)
    step = 100 / X.EARTH_M * 180 / 3.141592653589793
    for v in "ab":
        lon = [r.lon for r in sorted(got.where(F.col("id") == v).collect(), key=lambda r: r.sequence)]
        assert lon[0] is None and lon[6] is None
        assert lon[1:6] == pytest.approx([0.0, step, 2 * step, 3 * step, 1.0])


def test_a_long_gap_is_folded_in_blocks(spark):
    import math

    n = 700
    rows = [("a", i, i, 36.0, 10.0 if i == 0 else 11.0 if i == n else None, 20.0 if i == 0 else 21.0 if i == n else None) for i in range(n + 1)]
    df = spark.createDataFrame(rows, "id string, sequence long, t_sec long, speed double, lat double, lon double")
    got = {r.sequence: (r.lat, r.lon) for r in N.gps_deadreckon(df).collect()}
    p, q, p2, d = math.radians(10), math.radians(20), math.radians(11), math.radians(1)
    bearing, r = math.atan2(math.sin(d) * math.cos(p2), math.cos(p) * math.sin(p2) - math.sin(p) * math.cos(p2) * math.cos(d)), 10 / X.EARTH_M
    for i in range(1, n):
        new = math.asin(math.sin(p) * math.cos(r) + math.cos(p) * math.sin(r) * math.cos(bearing))
        q += math.atan2(math.sin(bearing) * math.sin(r) * math.cos(p), math.cos(r) - math.sin(p) * math.sin(new))
        p = new
        assert got[i] == pytest.approx((math.degrees(p), math.degrees(q)), abs=1e-9)


def test_frames_from_text_and_back(spark):
    lines = spark.createDataFrame([("date Mon",), ("   1.500000 1  18FF50E5x       Rx   d 8 01 02 0A FF 00 10 20 30",), ("junk",)], "value string")
    frames = W.frames_of_text(lines, 1000)
    (r,) = frames.collect()
    assert (r.ts_ms, r.can_id, r.bytes) == (2500, 0x18FF50E5, [1, 2, 10, 255, 0, 16, 32, 48])
    again = W.frames_of_text(W.text_of_frames(frames, 1000), 1000).collect()
    assert again == [r]


def test_dictionary_positions(spark):
    rows = [("f", i, x) for i, x in enumerate(["BO_ 2566844672 Temp: 8 X", ' SG_ T1 : 0|8@1+ (1,-40) [-40|210] "C"', ' SG_ T2 : 8|8@1+ (1,-40) [-40|210] "C"', "BO_ 7 Other: 8 X", ' SG_ V1 : 0|16@1+ (0.001,0) [0|5] "V"'])]
    got = W.dbc_dictionary(spark.createDataFrame(rows, "file string, n long, value string")).orderBy("dbc_id", "position").collect()
    assert [(r.dbc_id, r.position, r.signal, r.lo, r.hi) for r in got] == [(7, 0, "V1", 0.0, 5.0), (2566844672, 0, "T1", -40.0, 210.0), (2566844672, 1, "T2", -40.0, 210.0)]
    assert spark.range(1).select(W.raw_id(F.lit(2566844672))).first()[0] == 2566844672 & 0x7FFFFFFF


def test_row_differences_are_maps(spark):
    a = spark.createDataFrame([(1, 1.0, None), (2, 2.0, 3.0)], "k int, x double, y double")
    b = spark.createDataFrame([(1, 1.0, 5.0), (2, 2.0, 3.0), (3, 0.0, 0.0)], "k int, x double, y double")
    (r,) = Q.row_differences(Q.paired(a, b, ["k"]), ["k"], ["x", "y"]).collect()
    assert (r.k, r.differences) == (1, {"y": "null|5.0"})


def test_scans(spark, tmp_path):
    df = spark.createDataFrame([("a", "2024-01-01 18:29:59"), ("a", "2024-01-01 18:30:00"), ("b", "2024-01-02 18:30:00")], "id string, ts string").withColumn("ts", F.to_timestamp("ts"))
    assert S.scan_local_day(df, "2024-01-02").count() == 1
    assert S.scan_utc_window(df, "2024-01-02", 1).count() == 1
    df.withColumn("n", F.lit("7")).withColumn("bad", F.lit("x")).write.csv(str(tmp_path / "c"), header=True)
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("ts", T.TimestampType()), T.StructField("n", T.IntegerType()), T.StructField("gone", T.DoubleType())])
    got = dialects.scan_csv_conform(spark, str(tmp_path / "c"), schema)
    assert got.schema == schema and got.count() == 3
    text = spark.createDataFrame([("1", "2024-01-01", "x"), ("2.5", "?", "y")], "a string, b string, c string")
    assert {r.column: r.kind for r in S.infer_column_types(text).collect()} == {"a": "number", "b": "timestamp", "c": "string"}


def test_daily_sink_is_idempotent(spark, tmp_path):
    df = spark.createDataFrame([("2024-01-01", 1), ("2024-01-02", 2)], "date string, x int")
    for _ in range(2):
        S.sink_partitioned(df, str(tmp_path / "d"))
    S.sink_partitioned(df.where("x = 2").withColumn("x", F.lit(9)), str(tmp_path / "d"))
    assert sorted(r.x for r in spark.read.parquet(str(tmp_path / "d")).collect()) == [1, 9]


@pytest.fixture
def stream(spark, tmp_path):
    rows = [("a", 1_700_000_000 + 60 * i, 36.0 if 5 <= i < 15 else 30.0, "X" if i < 10 else "Y", 5.0) for i in range(30)] + [("z", 1_700_100_000, 0.0, "X", 0.0)]
    src = str(tmp_path / "in")
    spark.createDataFrame(rows, "id string, t long, tmax double, mode string, speed double").select("id", F.timestamp_seconds("t").alias("ts"), "tmax", "mode", "speed").coalesce(1).write.parquet(src)
    return spark.readStream.schema("id string, ts timestamp, tmax double, mode string, speed double").parquet(src)


def run(df, name, tmp_path):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name).collect()


def test_streaming_alert_period(stream, tmp_path):
    (r,) = run(jobs.stream_alert_periods(stream, F.col("tmax") > 35), "alerts", tmp_path)
    assert (r.end - r.start).total_seconds() == 540 and r.rows == 10


def test_streaming_mode_sessions(stream, tmp_path):
    got = sorted((r.id, r.mode, r.rows) for r in run(jobs.stream_mode_sessions(stream), "modes", tmp_path))
    assert ("a", "X", 10) in got and ("a", "Y", 20) in got
