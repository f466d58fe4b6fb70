"""Streamed mileage against the batch, in shuffled order and over a restart."""

import random

import pytest
from pyspark.sql import functions as F

from fleetlens.operators.buckets import mileage_energy
from fleetlens.sources.shared import written_in_order
from fleetlens.sources.telemetry import telemetry
from fleetlens.streaming import jobs

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture(scope="module")
def session(spark):
    s = spark.newSession()
    s.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    s.conf.set("spark.sql.shuffle.partitions", "2")
    return s


@pytest.fixture(scope="module")
def samples(session, data):
    df = telemetry(session, data).select("id", "t_sec", "sequence", "odo", "speed", "volts", "amps").where("id IN ('0', '1', '2', '3')")
    rows = sorted((tuple(r) for r in df.collect()), key=lambda r: r[1])
    assert len(rows) > 100
    # at most 500 seconds out of order
    rng = random.Random(1)
    return sorted(rows, key=lambda r: r[1] + rng.uniform(0, 500))


SCHEMA = "id string, t_sec long, sequence long, odo double, speed double, volts double, amps double"


def put(session, rows, path):
    session.createDataFrame(rows, SCHEMA).withColumn("ts", F.timestamp_seconds("t_sec")).coalesce(1).write.mode("append").parquet(path)


def run(session, src, out, state):
    stream = session.readStream.schema(f"{SCHEMA}, ts timestamp").option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(src)
    q = jobs.stream_mileage_15min(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
    q.awaitTermination(300)
    assert q.exception() is None


def compare(session, rows, out):
    want = mileage_energy(session.createDataFrame(rows, SCHEMA), 900, 0.01)
    got = session.read.parquet(out).where("id <> 'end'")
    assert sorted(tuple(r) for r in got.select(want.columns).collect()) == sorted(tuple(r) for r in want.collect())


def test_shuffled_stream_equals_the_batch_over_a_restart(session, samples, tmp_path):
    src, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    third = len(samples) // 3
    put(session, samples[:third], src)
    put(session, samples[third : 2 * third], src)
    run(session, src, out, state)
    # a new query goes on from the checkpoint
    put(session, samples[2 * third :], src)
    put(session, [("end", samples[-1][1] + 100_000, 0, None, None, None, None)], src)
    run(session, src, out, state)
    compare(session, samples, out)


def test_vehicles_share_the_calls_and_state_of_a_bucket(session, tmp_path):
    src, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    rng = random.Random(2)
    some = lambda x: None if rng.random() < 0.2 else float(x)
    rows = [(None if v == 7 else str(v), 90_000 + 30 * i + rng.randrange(30), i, some(v + i / 16), some(rng.randrange(3)), some(600), some(rng.randrange(-90, 90))) for v in range(60) for i in range(60)]
    # two samples of one time, in the order of their sequence; a vehicle that comes late
    rows += [("twice", 90_500, 2, 9.0, 1.0, 600.0, 5.0), ("twice", 90_500, 1, 7.0, 3.0, 600.0, -5.0), ("late", 91_790, 1, 7.0, 3.0, 600.0, -5.0)]
    rows.sort(key=lambda r: r[1] + rng.uniform(0, 500))
    for i in range(0, len(rows), 1300):
        put(session, rows[i : i + 1300], src)
    put(session, [("end", 200_000, 0, None, None, None, None)], src)
    stream = session.readStream.schema(f"{SCHEMA}, ts timestamp").option("maxFilesPerTrigger", 1).parquet(src)
    q = jobs.stream_mileage_15min(stream, buckets=2).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
    q.awaitTermination(300)
    assert q.exception() is None
    want = mileage_energy(session.createDataFrame(rows, SCHEMA), 900, 0.01)
    got = session.read.parquet(out).where("id <> 'end' OR id IS NULL")
    assert sorted((tuple(r) for r in got.select(want.columns).collect()), key=str) == sorted((tuple(r) for r in want.collect()), key=str)
    # of each bucket: last samples, held ones by batch, a timer and its place by time
    held = [s["numRowsTotal"] for p in q.recentProgress for s in p["stateOperators"] if "transformWithState" in s["operatorName"]]
    assert held and max(held) <= 20


def test_files_of_a_stream_follow_their_ranges(spark, tmp_path):
    df = spark.range(5000).select(F.pmod(F.xxhash64("id"), F.lit(1000)).alias("at"), "id")
    path = tmp_path / "in"
    written_in_order(df.withColumn("by", F.col("at")), "by", 7, str(path), df.where("id = 0").withColumn("at", F.lit(2000).cast("long")))
    files = sorted(path.glob("part-*"), key=lambda f: f.stat().st_mtime)
    parts = [[r[0] for r in spark.read.parquet(str(f)).select("at").collect()] for f in files]
    assert len({f.stat().st_mtime for f in files}) == len(files) == 8
    assert sum(map(len, parts)) == 5001 and all(max(a) < min(b) for a, b in zip(parts, parts[1:]))
