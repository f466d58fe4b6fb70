"""Queries: daily runs with carried state, and the streamed mileage."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.operators import states as S
from fleetlens.operators.incremental import run_days
from fleetlens.plans.registry import query
from fleetlens.plans.reports import _mileage
from fleetlens.plans.series import GUN
from fleetlens.sources.shared import new_folder, written_in_order
from fleetlens.sources.telemetry import telemetry as tel
from fleetlens.streaming.jobs import stream_mileage_15min as streamed

#: The telemetry view holds two hours of each vehicle, so that a day of these runs has half an hour.
DAY_SEC = 1800
#: Rows of a file of the stream, and files of a batch at most; a smaller table is four batches at least.
FILE_ROWS, BATCH_FILES = 250_000, 16


def _runs(spark, sf):
    df = tel(spark, sf).withColumn("mode", S.activity_state())
    return run_days(df, F.floor(F.col("t_sec") / DAY_SEC), new_folder(spark, "daily"))


_MODE = f"CASE WHEN {GUN} AND amps <= -5 THEN 'CHARGING_ACTIVE' WHEN {GUN} THEN 'CHARGING_IDLE' WHEN amps >= 5 THEN 'DISCHARGING_ACTIVE' ELSE 'DISCHARGING_IDLE' END"


@query("carry_over_chunks", """SELECT id, sequence, t_sec, t_sec - lag(t_sec) OVER ({o}) AS since, last_value(odo IGNORE NULLS) OVER ({o} {up}) AS odo,
 last_value(CASE WHEN lon IS NOT NULL THEN lat END IGNORE NULLS) OVER ({o} {up}) AS lat, last_value(CASE WHEN lat IS NOT NULL THEN lon END IGNORE NULLS) OVER ({o} {up}) AS lon FROM tel""")
def carry_over_chunks(spark, sf):
    """Run day by day, each on the state that the last one left; the SQL takes all days at once."""
    return _runs(spark, sf).samples()


@query("carry_over_sessions", f"""WITH m AS (SELECT id, t_sec, sequence, {_MODE} AS mode, last_value(odo IGNORE NULLS) OVER ({{o}} {{up}}) AS known FROM tel),
n AS (SELECT *, CASE WHEN lag(mode) OVER ({{o}}) = mode AND t_sec - lag(t_sec) OVER ({{o}}) <= 300 THEN 0 ELSE 1 END AS new, greatest(known - lag(known) OVER ({{o}}), CASE WHEN known - lag(known) OVER ({{o}}) IS NOT NULL THEN 0 END) AS rise FROM m),
r AS (SELECT *, sum(new) OVER ({{o}} {{up}}) AS run FROM n),
s AS (SELECT id, run, min(mode) AS mode, min(t_sec) AS start, max(t_sec) AS "end", count(*) AS rows, CAST(sum(CAST(CASE WHEN new = 0 THEN coalesce(rise, 0) ELSE 0 END AS DECIMAL(18,6))) AS double) AS km FROM r GROUP BY id, run)
SELECT id, mode, start, "end", rows, km, run = max(run) OVER (PARTITION BY id) AS "open" FROM s""")
def carry_over_sessions(spark, sf):
    """Sessions over the ends of days: those that closed on any day, and those still open."""
    return _runs(spark, sf).sessions()


@query("stream_mileage_15min", _mileage(900, 0.01))
def stream_mileage_15min(spark, sf):
    """The stream run to its end over files whose samples are out of order; the SQL is the batch's.

    State lies in RocksDB, which a session of its own is set to; the caller's settings stay as they are.
    """
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    own.conf.set("spark.sql.session.timeZone", "UTC")
    own.conf.set("spark.sql.shuffle.partitions", str(max(4, own.sparkContext.defaultParallelism)))
    source, out, state = (new_folder(spark, f"mileage-{x}") for x in ("in", "out", "state"))
    columns = ["id", "ts", "t_sec", "sequence", "odo", "speed", "volts", "amps"]
    rows = tel(own, sf).withColumn("ts", F.timestamp_seconds("t_sec")).select(columns)
    # a sample arrives up to 500 seconds after its time; a file holds what arrives within a span, a batch takes some files that follow each other
    files = max(4, -(-rows.count() // FILE_ROWS))
    arrives = rows.withColumn("arrives", F.col("t_sec") + F.pmod(F.xxhash64("id", "sequence"), F.lit(500)))
    # time goes on after the last sample
    last = rows.agg((F.coalesce(F.max("t_sec"), F.lit(0)) + 360_000).alias("t_sec"))
    last = last.select(F.lit("").alias("id"), F.timestamp_seconds("t_sec").alias("ts"), "t_sec", F.lit(0).cast("long").alias("sequence"), *(F.lit(None).cast("double").alias(c) for c in columns[4:]))
    written_in_order(arrives, "arrives", files, source, last)
    stream = own.readStream.schema(rows.schema).option("maxFilesPerTrigger", min(files // 4, BATCH_FILES)).parquet(source)
    job = streamed(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
    job.awaitTermination()
    return spark.read.parquet(out).where("id <> ''")
