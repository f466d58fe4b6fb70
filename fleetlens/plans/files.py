"""Queries that write files or tables and read them again."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.operators import enrich as N
from fleetlens.operators import sweeps as W
from fleetlens.plans.registry import query
from fleetlens.plans.sequences import _frames
from fleetlens.sources import dialects
from fleetlens.sources import tables as B
from fleetlens.sources import telemetry as S
from fleetlens.sources.shared import new_folder
from fleetlens.sources.telemetry import telemetry as tel


def _events(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet")


@query("scan_csv_conform", "SELECT event_id, user_id, event_type, value, props, CAST(floor(epoch(ts)) AS bigint) AS t, CAST(NULL AS int) AS missing FROM events WHERE event_id % 23 <> 0")
def scan_csv_conform(spark, sf):
    """Events as text in three dialects: commas; semicolons, single quotes and columns in another order; bars without a header. Some timestamps are bad."""
    ts = F.when(F.col("event_id") % 23 == 0, "n/a").otherwise(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    e, path = _events(spark, sf).withColumn("ts", ts), new_folder(spark, "csv")
    columns = ["event_id", "user_id", "event_type", "value", "props", "ts"]
    e.where("event_id % 3 = 0").select(*(F.col(c).alias(f" {c.upper()}") for c in columns)).write.csv(f"{path}/a", header=True)
    e.where("event_id % 3 = 1").select(*columns[::-1]).write.csv(f"{path}/b", header=True, sep=";", quote="'")
    e.where("event_id % 3 = 2").select(columns).write.csv(f"{path}/c", header=False, sep="|")
    schema = T.StructType.fromDDL("event_id long, user_id long, event_type string, value double, props string, ts timestamp, missing int")
    return dialects.scan_csv_conform(spark, path, schema).select("event_id", "user_id", "event_type", "value", "props", F.unix_seconds("ts").alias("t"), "missing")


#: Where in a row of the export the bytes 1 to 8 stand.
PLACES = [3, 0, 6, 1, 7, 2, 5, 4]
BASE_MS = 1_704_067_200_000


def _log(spark, sf):
    times = tel(spark, sf).select("id", "sequence", (F.col("t_sec") * 1000 + F.col("sequence") % 1000).alias("ts_ms"))
    return _frames(spark, sf).join(times, ["id", "sequence"]).select("ts_ms", "sequence", "can_id", "bytes")


_BYTES = "list_value(sequence % 251, sequence % 16, sequence % 241, sequence % 16, sequence % 239, sequence % 16, sequence % 233, sequence % 16)"
_LOG = f"SELECT t_sec * 1000 + sequence % 1000 AS ts_ms, sequence % 4 + 256 AS can_id, {_BYTES} AS b FROM tel"


@query("write_asc_frames", f"WITH f AS ({_LOG}) SELECT printf('%.6f 1 %08xx Rx d 8 ', (ts_ms - {BASE_MS}) / 1000, can_id) || " + " || ' ' || ".join(f"printf('%02x', b[{i + 1}])" for i in PLACES) + " AS line FROM f")
def write_asc_frames(spark, sf):
    """The lines of a written log, without its head."""
    path = new_folder(spark, "log")
    W.write_asc_frames(_log(spark, sf), path, BASE_MS, PLACES)
    return spark.read.text(path).where("value NOT LIKE 'date %' AND value NOT LIKE 'base %'").withColumnRenamed("value", "line")


@query("scan_asc_frames", f"WITH f AS ({_LOG}) SELECT ts_ms, can_id, " + ", ".join(f"CASE WHEN ts_ms % 5 = 0 AND {k} > 2 THEN 0 ELSE b[{i + 1}] END AS byte{k}" for k, i in enumerate(PLACES, 1)) + " FROM f")
def scan_asc_frames(spark, sf):
    """A log written and read again; every fifth millisecond's frames have two bytes alone."""
    path = new_folder(spark, "log")
    short = F.col("ts_ms") % 5 == 0
    lines = W.frame_lines(_log(spark, sf), BASE_MS, PLACES)
    lines.select(F.when(short, F.concat(F.substring_index("value", " d ", 1), F.lit(" d 2 "), F.substring_index(F.substring_index(F.substring_index("value", " d ", -1), " ", 3), " ", -2))).otherwise(F.col("value")).alias("value")).write.text(path)
    found = W.frames_of_text(spark.read.text(path), BASE_MS)
    return found.select("ts_ms", "can_id", *(F.get("bytes", F.lit(i)).cast("long").alias(f"byte{i + 1}") for i in range(8)))


@query("infer_column_types", "SELECT * FROM (VALUES ('o_orderkey', 'number'), ('o_orderdate', 'timestamp'), ('o_orderpriority', 'string'), ('price', 'string')) t(\"column\", kind) WHERE (SELECT count(*) FROM orders) > 0")
def infer_column_types(spark, sf):
    """Orders as text, a price of which is no number."""
    o = spark.read.parquet(f"{sf}/orders.parquet")
    price = F.when(F.col("o_orderkey") == F.lit(1), "n/a").otherwise(F.col("o_totalprice").cast("string"))
    return S.infer_column_types(o.select(F.col("o_orderkey").cast("string").alias("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"), "o_orderpriority", price.alias("price")))


_RULES = [("odo", "bigint", 1000.0, "distance_m"), ("vmax", "int", 1000.0, "cell_mv"), ("tmin", "decimal(4,1)", 1.0, "temperature"), ("soc", "decimal(4,1)", 1.0, "percent"), ("vmax_no", "smallint", 1.0, "sensor"), ("amps", "decimal(12,3)", 1.0, "analogue"), ("gear", "UNMAPPED", None, None)]


@query("dtype_rules", "WITH t AS (SELECT count(odo) AS odo, count(vmax) AS vmax, count(tmin) AS tmin, count(soc) AS soc, count(vmax_no) AS vmax_no, count(amps) AS amps, count(gear) AS gear FROM tel) " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", '{k}' AS type, {'CAST(NULL AS double)' if s is None else s} AS scale, {'NULL' if g is None else repr(g)} AS category, {c} AS filled FROM t" for c, k, s, g in _RULES))
def dtype_rules(spark, sf):
    """The rule of each column, beside how many values it has."""
    columns = [c for c, *_ in _RULES]
    df = tel(spark, sf).select(columns)
    filled = df.agg(*(F.count(c).alias(c) for c in columns)).select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("filled")) for c in columns))).alias("x")).select("x.*")
    return N.dtype_rules(df).drop("found").join(filled, "column").select("column", "type", "scale", "category", "filled")


@query("dbc_dictionary", "SELECT p_partkey + 2147483648 AS dbc_id, CAST(i AS int) AS position, 'SG' || i || '_' || p_partkey AS signal, CAST(-p_size AS double) AS lo, CAST(p_size * (i + 1) AS double) AS hi FROM part, range(3) t(i)")
def dbc_dictionary(spark, sf):
    """A dictionary with a message of three signals for each part, as text."""
    part = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", "p_size")
    head = F.struct(F.lit(0).alias("k"), F.format_string("BO_ %d Part_%d: 8 X", F.col("p_partkey") + 2147483648, F.col("p_partkey")).alias("value"))
    lines = [head, *(F.struct(F.lit(i + 1).alias("k"), F.format_string(f' SG_ SG{i}_%d : {8 * i}|8@1+ (1,0) [-%d|%d] "V" X', F.col("p_partkey"), F.col("p_size"), F.col("p_size") * (i + 1)).alias("value")) for i in range(3))]
    text = part.select("p_partkey", F.explode(F.array(*lines)).alias("x")).select((F.col("p_partkey") * 4 + F.col("x.k")).alias("n"), "x.value", F.concat(F.lit("f"), F.floor(F.col("p_partkey") / 500).cast("string")).alias("file"))
    return W.dbc_dictionary(text)


@query("sink_partitioned", "SELECT CAST(CAST(ts AS date) AS varchar) AS date, event_type, count(*) AS n, CAST(sum(CASE WHEN dayofmonth(ts) % 2 = 0 THEN 2 ELSE 1 END) AS bigint) AS version FROM events GROUP BY ALL")
def sink_partitioned(spark, sf):
    """All days are written, then the even ones again with another version: these replace theirs alone."""
    e, path = _events(spark, sf).select(F.to_date("ts").cast("string").alias("date"), "event_type", F.dayofmonth("ts").alias("day")), new_folder(spark, "days")
    S.sink_partitioned(e.select("date", "event_type", F.lit(1).alias("version")), path)
    S.sink_partitioned(e.where("day % 2 = 0").select("date", "event_type", F.lit(2).alias("version")), path)
    return spark.read.schema("event_type string, version int, date string").parquet(path).groupBy("date", "event_type").agg(F.count("*").alias("n"), F.sum("version").alias("version"))


@query("sink_ctas_replicate", "SELECT 'nation' AS \"table\", count(*) AS source_rows, count(*) AS target_rows FROM nation UNION ALL SELECT 'supplier', count(*), count(*) FROM supplier")
def sink_ctas_replicate(spark, sf):
    """Two tables of one schema copied into another."""
    source, target = (f"{x}_{uuid.uuid4().hex}" for x in ("source", "target"))
    for schema in (source, target):
        spark.sql(f"CREATE DATABASE {schema} LOCATION '{new_folder(spark, schema)}'")
    names = ["nation", "supplier"]
    for name in names:
        spark.read.parquet(f"{sf}/{name}.parquet").write.saveAsTable(f"{source}.{name}")
    return B.sink_ctas_replicate(spark, names, source, target)


@query("sink_csv_report", "SELECT id, count(*) AS n, round(avg(CAST(speed AS DECIMAL(18,6))), 3) AS speed FROM tel GROUP BY id")
def sink_csv_report(spark, sf):
    """A report of each vehicle, written and read again."""
    path = new_folder(spark, "report")
    S.sink_csv_report(tel(spark, sf).groupBy("id").agg(F.count("*").alias("n"), F.round(F.avg(F.col("speed").cast("decimal(18,6)")).cast("double"), 3).alias("speed")), path)
    return spark.read.csv(path, header=True, schema="id string, n long, speed double")


@query("stage_checkpoint", "SELECT id, sequence, CASE WHEN speed > 0 THEN 'moving' ELSE 'still' END AS state FROM tel")
def stage_checkpoint(spark, sf):
    """A stage that is done is read, whatever the frame says now; another key makes it anew."""
    path = new_folder(spark, "stage")
    df = tel(spark, sf).select("id", "sequence", F.when(F.col("speed") > 0, "moving").otherwise("still").alias("state"))
    S.stage_checkpoint(df.limit(0), path, "of nothing")
    S.stage_checkpoint(df, path, "of all")
    return S.stage_checkpoint(df.limit(0), path, "of all")
