"""Daily runs against one run over all days."""

import pytest
from pyspark.sql import functions as F

from fleetlens.operators import states as S
from fleetlens.operators.incremental import STATE, DailyRuns, advance, run_days
from fleetlens.sources.telemetry import telemetry


@pytest.fixture(scope="module")
def rows(spark, data):
    return telemetry(spark, data).withColumn("mode", S.activity_state()).cache()


def whole(spark, rows):
    samples, closed, after = advance(rows, spark.createDataFrame([], STATE))
    still = after.select("id", "mode", "start", F.col("t_sec").alias("end"), "rows", "km", F.lit(True).alias("open"))
    return everything(samples), everything(closed.withColumn("open", F.lit(False)).unionByName(still))


def everything(df):
    return sorted((tuple(r) for r in df.select(sorted(df.columns)).collect()), key=str)


@pytest.mark.parametrize("day_sec", [600, 1800, 86_400])
def test_days_one_by_one_equal_all_at_once(spark, rows, tmp_path, day_sec):
    runs = run_days(rows, F.floor(F.col("t_sec") / day_sec), str(tmp_path / "runs"))
    assert (everything(runs.samples()), everything(runs.sessions())) == whole(spark, rows)


def test_a_day_may_run_twice_and_break_off(spark, rows, tmp_path):
    df = rows.withColumn("day", F.floor(F.col("t_sec") / 1800).cast("int"))
    days = sorted(r[0] for r in df.select("day").distinct().collect())
    assert len(days) > 2
    runs = DailyRuns(spark, str(tmp_path / "runs"))
    for i, d in enumerate(days):
        day = df.where(F.col("day") == d)
        runs.run(day, d)
        if i == 1:
            runs.run(day, d)
        if i == 2:
            # a run that broke off before its state was in place: half of the rows, no rename
            samples, _, after = advance(day.where("sequence % 2 = 0"), runs.state(before=d))
            after.write.parquet(str(tmp_path / "runs" / "state" / "new-broken"))
            samples.withColumn("day", F.lit(d)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(str(tmp_path / "runs" / "samples"))
            runs.run(day, d)
    assert runs.days() == days
    assert (everything(runs.samples()), everything(runs.sessions())) == whole(spark, rows)


def test_a_vehicle_that_rests_for_a_day(spark, tmp_path):
    rows = [("a", 10, 1, 5.0, 1.0, 2.0, "X"), ("a", 50, 2, None, None, None, "X"), ("b", 60, 1, None, None, 3.0, None), ("b", 150, 2, 7.0, 4.0, 5.0, None), ("a", 240, 3, 9.0, None, 1.0, "X"), ("a", 250, 4, None, None, None, "Y")]
    df = spark.createDataFrame(rows, "id string, t_sec long, sequence long, odo double, lat double, lon double, mode string")
    runs = run_days(df, F.floor(F.col("t_sec") / 100), str(tmp_path / "runs"))
    got = {(r.id, r.sequence): (r.since, r.odo, r.lat, r.lon) for r in runs.samples().collect()}
    assert got == {("a", 1): (None, 5.0, 1.0, 2.0), ("a", 2): (40, 5.0, 1.0, 2.0), ("b", 1): (None, None, None, None), ("b", 2): (90, 7.0, 4.0, 5.0), ("a", 3): (190, 9.0, 1.0, 2.0), ("a", 4): (10, 9.0, 1.0, 2.0)}
    assert everything(runs.sessions()) == sorted([(240, "a", 4.0, "X", False, 3, 10), (250, "a", 0.0, "Y", True, 1, 250), (150, "b", 0.0, None, True, 2, 60)], key=str)


def test_the_number_of_days_does_not_multiply_what_is_read(spark, rows, tmp_path):
    n, read = rows.count(), spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(len(b))
            yield b

    df = spark.createDataFrame(rows.toArrow()).mapInArrow(counted, rows.schema)
    runs = run_days(df, F.floor(F.col("t_sec") / 600), str(tmp_path / "runs"))
    assert len(runs.days()) > 4 and runs.samples().count() == n
    # once to find the ranges, once to write the days
    assert n <= read.value <= 2 * n
    assert sorted(p.name for p in (tmp_path / "runs").iterdir()) == ["samples", "sessions", "state"]
