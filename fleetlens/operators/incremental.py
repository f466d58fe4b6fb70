"""Daily runs: each takes one day's samples and what the days before have left of every vehicle.

The state of a vehicle is its last sample, its last known odometer reading and fix, and its open session. A run puts it before
the day's samples as one more row, so that the windows of the whole table do the work; no row of an earlier day is read.
What a run gives out: the samples with carried odometer and fix and the time since the sample before, and the sessions that
closed. Days taken one by one give what one run over all of them gives.

`DailyRuns` keeps states and results by day. A day's results replace those of an earlier run of that day; its state is
written beside the others and moved to its place in one rename, last. A day that is run twice, or whose first run broke
off, starts from the state of the day before it both times.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetlens.operators.timeseries import ID, SEQ, T, series, up_to_here
from fleetlens.sources.telemetry import sink_partitioned

ROWS = "id string, t_sec long, sequence long, odo double, lat double, lon double, mode string"
STATE = "id string, t_sec long, sequence long, odo double, lat double, lon double, mode string, start long, rows long, km double"
SAMPLES = "id string, sequence long, t_sec long, since long, odo double, lat double, lon double"
SESSIONS = "id string, mode string, start long, end long, rows long, km double"


def carried(rows: DataFrame, state: DataFrame, max_gap_sec: int = 300) -> DataFrame:
    """The state's rows and those of the day behind them, with what is known at each, the time since the row before, and the number of its run."""
    day = rows.select(ID, T, SEQ, "odo", "lat", "lon", "mode", F.lit(None).cast("long").alias("start"), F.lit(None).cast("long").alias("rows"), F.lit(None).cast("double").alias("km"), F.lit(False).alias("carried"))
    both = day.unionByName(state.select(*day.columns[:-1], F.lit(True).alias("carried")))
    fix = F.when(F.col("lat").isNotNull() & F.col("lon").isNotNull(), F.struct("lat", "lon"))
    both = both.withColumns({"known": F.last("odo", True).over(up_to_here()), "fix": F.last(fix, True).over(up_to_here()), "since": F.col(T) - F.lag(T).over(series())})
    new = F.lag(F.lit(1)).over(series()).isNull() | ~F.col("mode").eqNullSafe(F.lag("mode").over(series())) | (F.col("since") > max_gap_sec)
    both = both.withColumns({"new": new.cast("int"), "rise": F.greatest(F.col("known") - F.lag("known").over(series()), F.lit(0.0))})
    return both.withColumn("run", F.sum("new").over(up_to_here())).drop("odo", "lat", "lon")


def sessions_of(both: DataFrame) -> DataFrame:
    """The sessions of `carried`, with what is known at their ends; `last` ones are still open."""
    # the carried row stands for all rows of its session
    at = F.struct(T, SEQ)
    sessions = both.groupBy(ID, "run").agg(
        F.first("mode").alias("mode"), F.min(F.coalesce("start", T)).alias("start"), F.max(T).alias("end"), F.sum(F.coalesce("rows", F.lit(1))).alias("rows"),
        F.sum(F.when(F.col("carried"), F.col("km")).when(F.col("new") == 0, F.col("rise")).otherwise(0.0).cast("decimal(18,6)")).cast("double").alias("km"),
        F.max_by(SEQ, at).alias(SEQ), F.max_by("known", at).alias("odo"), F.max_by("fix", at).alias("fix"),
    )
    return sessions.withColumn("last", F.col("run") == F.max("run").over(Window.partitionBy(ID)))


def parted(both: DataFrame, sessions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(samples, closed sessions, next state)."""
    samples = both.where("NOT carried").select(ID, SEQ, T, "since", F.col("known").alias("odo"), "fix.lat", "fix.lon")
    closed = sessions.where("NOT last").select(ID, "mode", "start", "end", "rows", "km")
    after = sessions.where("last").select(ID, F.col("end").alias(T), SEQ, "odo", "fix.lat", "fix.lon", "mode", "start", "rows", "km")
    return samples, closed, after


def advance(rows: DataFrame, state: DataFrame, max_gap_sec: int = 300) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(samples, closed sessions, next state). rows: id, t_sec, sequence, odo, lat, lon, mode; later than the state's.

    A session is a run of one mode (nulls are a mode too) without a gap above max_gap_sec; km sums the rises of the carried odometer inside it.
    """
    both = carried(rows, state, max_gap_sec)
    return parted(both, sessions_of(both))


class DailyRuns:
    """States, samples and sessions of daily runs below one folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str, max_gap_sec: int = 300):
        self.spark, self.path, self.max_gap_sec = spark, path, max_gap_sec
        self.fs_path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.fs_path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def days(self) -> list[int]:
        """Days with a state, in order."""
        top = self.fs_path(f"{self.path}/state")
        if not self.fs.exists(top):
            return []
        return sorted(int(name[4:]) for s in self.fs.listStatus(top) if (name := s.getPath().getName()).startswith("day="))

    def state(self, before: int | None = None) -> DataFrame:
        """The state after the last day, or after the last day before another."""
        days = [d for d in self.days() if before is None or d < before]
        if not days:
            return self.spark.createDataFrame([], STATE)
        return self.spark.read.schema(STATE).parquet(f"{self.path}/state/day={days[-1]}")

    def run(self, rows: DataFrame, day: int) -> None:
        """Takes the samples of a day. A day before one that has run already makes the later ones out of date: run them again."""
        both = carried(rows, self.state(before=day), self.max_gap_sec)
        # closed sessions and state both come from one copy of the sessions
        copy = f"{self.path}/ended-{uuid.uuid4().hex}"
        sessions = sessions_of(both)
        sessions.write.parquet(copy)
        samples, closed, after = parted(both, self.spark.read.schema(sessions.schema).parquet(copy))
        for df, name in ((samples, "samples"), (closed, "sessions")):
            sink_partitioned(df.withColumn("day", F.lit(day)), f"{self.path}/{name}", "day")
        new, place = self.fs_path(f"{self.path}/state/new-{uuid.uuid4().hex}"), self.fs_path(f"{self.path}/state/day={day}")
        after.write.parquet(new.toString())
        self.fs.delete(self.fs_path(copy), True)
        self.fs.delete(place, True)
        if not self.fs.rename(new, place):
            raise OSError(f"the state of day {day} could not be moved to its place")

    def samples(self) -> DataFrame:
        return self.spark.read.schema(f"{SAMPLES}, day int").parquet(f"{self.path}/samples").drop("day")

    def sessions(self) -> DataFrame:
        """Closed sessions of all days, and the open ones."""
        closed = self.spark.read.schema(f"{SESSIONS}, day int").parquet(f"{self.path}/sessions").drop("day").withColumn("open", F.lit(False))
        still = self.state().select(ID, "mode", "start", F.col(T).alias("end"), "rows", "km", F.lit(True).alias("open"))
        return closed.unionByName(still)


def run_days(rows: DataFrame, day: Column, path: str, max_gap_sec: int = 300) -> DailyRuns:
    """Runs every day of rows, from the first to the last. There are as many rows on the driver as days.

    rows are written once by day first, so that a day reads its own; that copy is deleted at the end.
    """
    runs = DailyRuns(rows.sparkSession, path, max_gap_sec)
    copy = f"{path}/rows-{uuid.uuid4().hex}"
    rows = rows.select(*(name.split()[0] for name in ROWS.split(", ")), day.cast("int").alias("day"))
    # ranges, so that one day is many tasks and a task few files
    rows.repartitionByRange("day", ID).write.partitionBy("day").parquet(copy)
    by_day = runs.spark.read.schema(f"{ROWS}, day int").parquet(copy)
    for (d,) in by_day.select("day").distinct().orderBy("day").collect():
        runs.run(by_day.where(F.col("day") == d), d)
    runs.fs.delete(runs.fs_path(copy), True)
    return runs
