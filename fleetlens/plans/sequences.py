"""Queries: sweeps, frames and steps that look at one sample at a time."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.operators import states as S
from fleetlens.operators import sweeps as W
from fleetlens.operators.timeseries import series
from fleetlens.plans.registry import query
from fleetlens.plans.series import GUN
from fleetlens.sources.telemetry import telemetry as tel


def cycles_sql(items: str, n: int, where: str = "true") -> str:
    """Recursive SQL of covers: `cy` has them; `items` is a list of a row's numbers."""
    nexts = ", ".join(f"min(CASE WHEN list_contains(s, {i}) THEN n END) OVER w AS x{i}" for i in range(n))
    every = " AND ".join(f"x{i} IS NOT NULL" for i in range(n))
    return f"""WITH RECURSIVE ra AS (SELECT id, t_sec, sequence, row_number() OVER ({{o}}) AS n, s, tmax FROM (SELECT *, {items} AS s FROM tel) WHERE {where}),
na AS (SELECT id, n, {nexts} FROM ra WINDOW w AS (PARTITION BY id ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
li AS (SELECT id, n, greatest({", ".join(f"x{i}" for i in range(n))}) AS l FROM na WHERE {every}),
ch AS (SELECT id, CAST(1 AS bigint) AS cycle, n AS f, l FROM li WHERE n = 1 UNION ALL SELECT li.id, cycle + 1, li.n, li.l FROM ch JOIN li ON li.id = ch.id AND li.n = ch.l + 1),
cy AS (SELECT ch.id, cycle, f, l, a.t_sec AS start, b.t_sec AS "end", l - f + 1 AS rows, a.t_sec - lag(b.t_sec) OVER (PARTITION BY ch.id ORDER BY cycle) AS since
       FROM ch JOIN ra a ON a.id = ch.id AND a.n = ch.f JOIN ra b ON b.id = ch.id AND b.n = ch.l)"""


SENSOR_CYCLES = cycles_sql("[tmax_no % 8]", 8)
#: Chunks of half an hour, as the telemetry view holds two hours of each vehicle.
CHUNK = 1800


@query("sweep_cycles", SENSOR_CYCLES + ' SELECT id, cycle, start, "end", rows, since FROM cy')
def sweep_cycles(spark, sf):
    return W.sweep_cycles(tel(spark, sf).withColumn("sensor", F.col("tmax_no") % 8), 8, chunk_sec=CHUNK)


_STATE = f"CASE WHEN {GUN} AND amps <= -5 THEN 'CHARGING_ACTIVE' WHEN {GUN} THEN 'CHARGING_IDLE' WHEN amps >= 5 THEN 'DISCHARGING_ACTIVE' ELSE 'DISCHARGING_IDLE' END"


@query("micro_blip_smooth", f"""WITH RECURSIVE m AS (SELECT id, sequence, {_STATE} AS mode, row_number() OVER ({{o}}) AS n, t_sec - lag(t_sec) OVER ({{o}}) AS dt FROM tel),
d AS (SELECT *, split_part(mode, '_', 1) AS dom, lead(split_part(mode, '_', 1)) OVER (PARTITION BY id ORDER BY n) AS nxt FROM m),
r AS (SELECT id, n, sequence, mode AS smoothed, dom FROM d WHERE n = 1
      UNION ALL SELECT d.id, d.n, d.sequence, CASE WHEN r.dom = d.nxt AND d.nxt <> d.dom AND d.dt <= 60 THEN r.dom || '_ACTIVE' ELSE d.mode END, CASE WHEN r.dom = d.nxt AND d.nxt <> d.dom AND d.dt <= 60 THEN r.dom ELSE d.dom END
      FROM r JOIN d ON d.id = r.id AND d.n = r.n + 1)
SELECT id, sequence, smoothed FROM r""")
def micro_blip_smooth(spark, sf):
    """A running value; the SQL goes from sample to sample."""
    return W.micro_blip_smooth(tel(spark, sf).withColumn("mode", S.activity_state()))


@query("brake_to_stop_60s", """WITH RECURSIVE b AS (SELECT id, t_sec, speed, coalesce(lead(brake) OVER ({o}), 0) AS brake, row_number() OVER ({o}) AS n FROM tel),
p AS (SELECT id, n, t_sec, speed FROM b WHERE brake > 0 AND speed > 1),
s AS (SELECT p.id, p.n, p.t_sec AS start, p.speed AS start_speed, (SELECT min(n) FROM b WHERE b.id = p.id AND b.n > p.n AND b.speed <= 0.1 AND b.t_sec - p.t_sec <= 120) AS m FROM p),
k AS (SELECT s.*, b.t_sec AS stop FROM s JOIN b ON b.id = s.id AND b.n = s.m),
r AS (SELECT id, n, m, start, stop, start_speed FROM k QUALIFY row_number() OVER (PARTITION BY id ORDER BY n) = 1
      UNION ALL SELECT id, n, m, start, stop, start_speed FROM (SELECT k.*, row_number() OVER (PARTITION BY k.id ORDER BY k.n) AS place FROM r JOIN k ON k.id = r.id AND k.n > r.m) WHERE place = 1)
SELECT id, start, stop, start_speed FROM r""")
def brake_to_stop_60s(spark, sf):
    """In the view a press stands on the sample after the moving one; here it counts for the one before. The SQL searches anew behind each stop."""
    df = tel(spark, sf)
    return W.brake_to_stop(df.withColumn("brake", F.coalesce(F.lead("brake").over(series()), F.lit(0))), within_sec=120)


def _frames(spark, sf):
    """A frame for each sample, made of its numbers."""
    df = tel(spark, sf)
    by = [F.col("sequence") % m for m in (251, 16, 241, 16, 239, 16, 233, 16)]
    return df.select("id", "sequence", (F.col("sequence") % 4 + 256).alias("can_id"), F.array(*(b.cast("int") for b in by)).alias("bytes"))


_SIGNALS = [(256 + i, k, "temperature" if i % 2 else "voltage", 8 * i + k) for i in range(4) for k in range(8 if i % 2 else 4)]


@query("decode_frames", "WITH f AS (SELECT id, sequence, sequence % 4 AS c, list_value(sequence % 251, sequence % 16, sequence % 241, sequence % 16, sequence % 239, sequence % 16, sequence % 233, sequence % 16) AS b FROM tel), s AS (SELECT c, k, 8 * c + k AS no FROM range(4) t(c), range(8) u(k) WHERE c % 2 = 1 OR k < 4) SELECT id, sequence, CASE WHEN s.c % 2 = 1 THEN 'temperature' ELSE 'voltage' END AS kind, no AS sensor_no, round(CASE WHEN s.c % 2 = 1 THEN b[k + 1] - 40 ELSE (b[2 * k + 1] + 256 * b[2 * k + 2]) * 0.001 END, 3) AS value FROM f JOIN s ON f.c = s.c")
def decode_frames(spark, sf):
    signals = spark.createDataFrame(_SIGNALS, "can_id long, k int, kind string, sensor_no long")
    return W.decode_frames(_frames(spark, sf), signals).select("id", "sequence", "kind", "sensor_no", F.round("value", 3).alias("value"))


@query("search_frames", "WITH f AS (SELECT sequence % 97 AS c, count(*) AS n FROM tel GROUP BY 1) SELECT c AS can_id, n FROM f WHERE n > 10 AND n < 5000")
def search_frames(spark, sf):
    """Ids whose frequency lies in a band."""
    return W.frequent_ids(tel(spark, sf).select((F.col("sequence") % 97).alias("can_id")), 10, 5000)


@query("search_frames_bytes", "SELECT id, sequence FROM tel WHERE sequence % 4 = 1 AND sequence % 16 = 5 AND sequence % 251 < 256 AND sequence % 241 = 7")
def search_frames_bytes(spark, sf):
    """Frames of one id with two bytes given."""
    return W.search_frames(_frames(spark, sf), 257, {2: 5, 3: 7}).select("id", "sequence")


@query("dead_stuck_range", "SELECT sensor_no, count(v) AS n, count(v) = 0 AS dead, count(v) > 0 AND (coalesce(stddev_samp(v), 0) < 1e-4 OR count(DISTINCT v) <= 2) AS stuck, count(CASE WHEN v < 3.21 OR v > 3.24 THEN 1 END) AS out_of_range FROM (SELECT vmax_no AS sensor_no, CASE WHEN vmax_no % 7 <> 0 THEN vmax END AS v FROM tel) GROUP BY sensor_no")
def dead_stuck_range(spark, sf):
    long = tel(spark, sf).select(F.col("vmax_no").alias("sensor_no"), F.when(F.col("vmax_no") % 7 != 0, F.col("vmax")).alias("value"))
    return W.sensor_health(long, 3.21, 3.24)


@query("robust_z_outliers", "WITH l AS (SELECT id, sequence, value FROM (SELECT user_id AS id, event_id AS sequence, value FROM events)), m AS (SELECT id, median(value) AS m FROM l GROUP BY id), d AS (SELECT l.*, m, abs(value - m) AS d FROM l JOIN m ON l.id = m.id), k AS (SELECT id, median(d) AS mad FROM d GROUP BY id) SELECT d.id, sequence, round(0.6745 * (value - m) / nullif(mad, 0), 4) AS z FROM d JOIN k ON d.id = k.id WHERE abs(0.6745 * (value - m) / nullif(mad, 0)) > 3")
def robust_z_outliers(spark, sf):
    long = spark.read.parquet(f"{sf}/events.parquet").select(F.col("user_id").alias("id"), F.col("event_id").alias("sequence"), "value")
    return W.robust_outliers(long, ["id"]).select("id", "sequence", F.round("z", 4).alias("z"))
