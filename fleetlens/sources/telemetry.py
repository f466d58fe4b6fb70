"""Scans: conforming schemas, local days, windows; and the telemetry view of an event table."""

from __future__ import annotations

import re
from datetime import date, datetime, timedelta, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Telemetry derived from the events table, in SQL that Spark and DuckDB both run.
VIEW = """
SELECT CAST(user_id AS string) AS id, event_id AS sequence, t_sec,
  CASE WHEN event_id % 13 = 0 THEN NULL ELSE gun0 END AS gun,
  CASE WHEN spd > 0 THEN 1 ELSE 0 END AS ready,
  CASE WHEN spd > 0 OR gun0 = 1 OR event_id % 3 = 0 THEN 1 ELSE 0 END AS ignition,
  CAST(spd AS double) AS speed,
  CASE WHEN spd > 0 THEN 2 ELSE 0 END AS gear,
  CASE WHEN event_type = 'error' THEN event_id % 60 ELSE 0 END AS brake,
  CAST(CASE WHEN event_type = 'error' THEN NULL
            WHEN event_id % 211 = 0 THEN 3200
            WHEN gun0 = 1 THEN -(event_id % 120)
            WHEN spd > 0 THEN 20 + event_id % 150
            ELSE event_id % 7 - 3 END AS double) AS amps,
  CAST(CASE WHEN event_id % 97 = 0 THEN 0 ELSE 600 + event_id % 41 END AS double) AS volts,
  CAST(CASE WHEN event_id % 37 = 0 THEN 0
            WHEN gun0 = 1 THEN 30 + seq % 60 ELSE 95 - seq % 70 END AS double) AS soc,
  CAST(98 AS double) AS soh,
  CASE WHEN event_id % 5 IN (1, 2) THEN NULL
       ELSE CAST(1000 * user_id AS double) + CAST(seq AS double) / 16 END AS odo,
  CAST(CASE WHEN event_id % 53 = 0 THEN -40 ELSE 24 + event_id % 20 END AS double) AS tmax,
  CAST(24 + event_id % 20 - event_id % 10 AS double) AS tmin,
  CAST(3200 + event_id % 50 AS double) / 1000 AS vmax,
  CAST(3200 AS double) / 1000 AS vmin,
  1 + event_id % 110 AS tmax_no, 1 + (event_id * 3) % 110 AS tmin_no,
  1 + event_id % 580 AS vmax_no, 1 + (event_id * 7) % 580 AS vmin_no,
  CASE WHEN event_id % 4 = 0 THEN 'Off' WHEN gun0 = 1 THEN 'Charging_Cooling'
       ELSE 'Self_Circulation' END AS tms_mode,
  CASE WHEN event_id % 6 = 0 THEN NULL
       WHEN CAST(floor(seq / 60.0) AS bigint) % 2 = 0 THEN 30.287722 ELSE 28.423090 END
    + CAST(seq % 60 - 30 AS double) / 2048 AS lat,
  CASE WHEN event_id % 6 = 0 THEN NULL
       WHEN CAST(floor(seq / 60.0) AS bigint) % 2 = 0 THEN CAST(77.999029 AS double) ELSE CAST(76.991733 AS double) END AS lon
FROM (SELECT *, CASE WHEN gun0 = 1 THEN 0 WHEN event_type IN ('click', 'purchase') THEN event_id % 81 ELSE 0 END AS spd
  FROM (SELECT *, CASE WHEN CAST(floor(seq / 20.0) AS bigint) % 3 = 0 THEN 1 ELSE 0 END AS gun0,
          1704067200 + seq * 30 + (event_id % 7) + CAST(floor(seq / 25.0) AS bigint) * 1200 AS t_sec
    FROM (SELECT event_id, user_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events) AS s) AS g) AS v
"""


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each sample of a vehicle: (id, t_sec, sequence) in order."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type", "value", "ts")
    return spark.sql(VIEW.replace("FROM events", "FROM {events}"), events=events)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The schema's columns in its order; missing ones are typed nulls, others are cast (null where that fails)."""
    have = set(df.columns)
    return df.select(*(F.col(f.name).try_cast(f.dataType).alias(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in schema))


def scan_local_day(df: DataFrame, day: str, tz: str = "Asia/Kolkata", ts_col: str = "ts", dt_col: str | None = None) -> DataFrame:
    """Rows of one local calendar day, whose bounds reach the scan; on a table with a UTC day column only that day's partition and its neighbours are read."""
    d, zone = date.fromisoformat(day), ZoneInfo(tz)
    low, high = (datetime(x.year, x.month, x.day, tzinfo=zone).astimezone(timezone.utc) for x in (d, d + timedelta(1)))
    if dt_col:
        df = df.where(F.col(dt_col).between(F.lit(low.date()), F.lit(high.date())))
    naive = df.schema[ts_col].dataType.typeName() == "timestamp_ntz"
    bound = lambda x: F.lit(x.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz") if naive else F.lit(x)
    return df.where((F.col(ts_col) >= bound(low)) & (F.col(ts_col) < bound(high)))


def reorder_columns(df: DataFrame, order: list[str]) -> DataFrame:
    """The columns named first, those that are there, in that order; others behind them."""
    first = [c for c in order if c in df.columns]
    return df.select(*first, *(c for c in df.columns if c not in first))


def regex_columns(df: DataFrame, pattern: str, always: tuple[str, ...] = ()) -> DataFrame:
    """The columns in `always`, and those whose name holds the pattern."""
    return df.select(*(c for c in df.columns if c in always or re.search(pattern, c)))


def stage_checkpoint(df: DataFrame, path: str, key: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Writes a state once, as Parquet in a folder that all executors share, and reads it back; later stages start from there.

    key names what the state was made from (a day, a version of the input): under another key it is written anew. A
    folder that a stage has completed before is read, not written again.
    """
    spark, place = df.sparkSession, f"{path}/{re.sub(r'[^0-9A-Za-z_.-]', '_', key)}"
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{place}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        df.write.mode("overwrite").partitionBy(*partition_by).parquet(place)
    return spark.read.parquet(place)


def scan_utc_window(df: DataFrame, day: str, days: int = 31, offset_minutes: int = 330, ts_col: str = "ts") -> DataFrame:
    """Half-open window of local days at a fixed offset from UTC."""
    low = F.lit(day).cast("timestamp") - F.expr(f"INTERVAL {offset_minutes} MINUTES")
    return df.where((F.col(ts_col) >= low) & (F.col(ts_col) < low + F.expr(f"INTERVAL {days} DAYS")))


def scan_date_range(df: DataFrame, first: str, last: str | None = None, days: int | None = None, dt: str = "dt") -> DataFrame:
    """Inclusive date range, or first day and number of days."""
    end = last or (date.fromisoformat(first) + timedelta((days or 1) - 1)).isoformat()
    return df.where(F.col(dt).between(F.lit(first).cast("date"), F.lit(end).cast("date")))


def scan_distinct_ids(df: DataFrame, ids: DataFrame | None = None, id_col: str = "id") -> DataFrame:
    out = df.select(id_col).distinct()
    return out.join(ids.select(id_col), id_col, "left_semi") if ids is not None else out


def scan_parquet_window(spark: SparkSession, path: str, columns: list[str], low: str, high: str, ts_col: str = "ts", ids: list[str] | None = None, id_col: str = "id") -> DataFrame:
    df = spark.read.parquet(path).where(F.col(ts_col).between(F.lit(low).cast("timestamp_ntz"), F.lit(high).cast("timestamp_ntz")))
    return (df.where(F.col(id_col).isin(ids)) if ids else df).select(*columns)


def typed_projection(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Casts by name; UNMAPPED keeps the type; values that don't fit are null."""
    return df.select(*(F.col(c) if t == "UNMAPPED" else F.col(c).try_cast(t).alias(c) for c, t in types.items()))


def rename_signals(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed({a: b for a, b in names.items() if a in df.columns})


def infer_column_types(df: DataFrame) -> DataFrame:
    """(column, kind) of text columns: number if all values parse, else timestamp if half do, else string."""
    stats = [x for c in df.columns for x in (F.count(c).alias(f"{c}:n"), F.count(F.col(c).try_cast("double")).alias(f"{c}:d"), F.count(F.try_to_timestamp(F.col(c))).alias(f"{c}:t"))]
    one = df.agg(*stats)
    rows = [F.struct(F.lit(c).alias("column"), F.when((F.col(f"`{c}:n`") > 0) & (F.col(f"`{c}:d`") == F.col(f"`{c}:n`")), "number").when(F.col(f"`{c}:t`") * 2 >= F.greatest(F.col(f"`{c}:n`"), F.lit(1)), "timestamp").otherwise("string").alias("kind")) for c in df.columns]
    return one.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def sink_partitioned(df: DataFrame, path: str, partition_by: str = "date") -> None:
    """Idempotent: days that df holds replace those stored, others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition_by).parquet(path)


def sink_csv_report(df: DataFrame, path: str, most_rows: int = 1_000_000) -> int:
    """Writes a report of at most most_rows rows as one file with a header; a larger one in parts, each with the header. Gives the number of rows."""
    n = df.limit(most_rows + 1).count()
    (df.coalesce(1) if n <= most_rows else df).write.mode("overwrite").csv(path, header=True)
    return n if n <= most_rows else df.count()
