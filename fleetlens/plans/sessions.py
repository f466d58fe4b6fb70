"""Queries: sessions, periods, events, sites and trips."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from fleetlens.functions.expressions import flag
from fleetlens.operators import sessions as E
from fleetlens.operators import states as S
from fleetlens.operators import trips as R
from fleetlens.operators.timeseries import islands
from fleetlens.plans.registry import query
from fleetlens.plans.series import GUN
from fleetlens.sources.telemetry import telemetry as tel

MODE = f"CASE WHEN {GUN} AND amps <= -5 THEN 'CHARGING_ACTIVE' WHEN {GUN} THEN 'CHARGING_IDLE' WHEN amps >= 5 THEN 'DISCHARGING_ACTIVE' ELSE 'DISCHARGING_IDLE' END"
#: SQL for runs: numbers them in column g.
RUNS = "SELECT *, sum(CASE WHEN k IS NOT DISTINCT FROM pk AND pt IS NOT NULL AND NOT ({extra}) THEN 0 ELSE 1 END) OVER ({{o}} {{up}}) AS g FROM (SELECT *, lag(k) OVER ({{o}}) AS pk, lag(t_sec) OVER ({{o}}) AS pt FROM (SELECT *, {key} AS k FROM {of}))"


def runs(key: str, extra: str = "false", of: str = "tel") -> str:
    return RUNS.format(key=key, extra=extra, of=of).replace("{{", "{").replace("}}", "}")


_SESS = runs(MODE, "t_sec - pt > 300")


@query("mode_gap_sessions", """
SELECT user_id, session, count(*) AS events, min(ts) AS first_ts, max(ts) AS last_ts
FROM (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS session
  FROM (SELECT *, CASE WHEN epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) <= 28800 THEN 0 ELSE 1 END AS n FROM events))
GROUP BY user_id, session""")
def mode_gap_sessions(spark, sf):
    """Sessions of a user's events, cut at pauses over eight hours."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = spark.read.parquet(f"{sf}/events.parquet").select("user_id", "event_id", "ts")
    sec = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    new = F.when(sec - F.lag(sec).over(w) <= 28_800, 0).otherwise(1)
    e = e.withColumn("new", new).withColumn("session", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return e.groupBy("user_id", "session").agg(F.count("*").alias("events"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("mode_sessions_telemetry", f"SELECT id, CAST(g AS bigint) AS session, min(k) AS mode, count(*) AS n FROM ({_SESS}) GROUP BY id, g")
def mode_sessions_telemetry(spark, sf):
    df = E.mode_gap_sessions(tel(spark, sf).withColumn("mode", S.activity_state()), F.col("mode"))
    return df.groupBy("id", "session").agg(F.min("mode").alias("mode"), F.count("*").alias("n"))


_ENV = "WITH r AS (SELECT id, g, min(t_sec) AS s, max(t_sec) AS e FROM (" + runs(f"({MODE}) LIKE 'CHARGING%'") + """) WHERE k GROUP BY id, g),
v AS (SELECT *, sum(CASE WHEN s - pe <= 900 THEN 0 ELSE 1 END) OVER (PARTITION BY id ORDER BY s) AS envelope FROM (SELECT *, lag(e) OVER (PARTITION BY id ORDER BY s) AS pe FROM r)) """


@query("charging_envelopes", _ENV + 'SELECT id, CAST(envelope AS bigint) AS envelope, min(s) AS start, max(e) AS "end" FROM v GROUP BY ALL')
def charging_envelopes(spark, sf):
    return E.charging_envelopes(tel(spark, sf).withColumn("mode", S.activity_state()))


@query("partition_day_sessions", _ENV + """, w AS (SELECT id, envelope, min(s) AS s, max(e) AS e FROM v GROUP BY ALL),
x AS (SELECT t.*, coalesce(w.envelope, -1) AS k FROM tel t LEFT JOIN w ON t.id = w.id AND t.t_sec BETWEEN w.s AND w.e)
SELECT id, sequence, CAST(g AS bigint) AS segment FROM (""" + runs("k0", of="(SELECT * EXCLUDE (k), k AS k0 FROM x)") + ")")
def partition_day_sessions(spark, sf):
    return E.day_segments(tel(spark, sf).withColumn("mode", S.activity_state())).select("id", "sequence", "segment")


_METRICS = f"""WITH s AS ({_SESS}), d AS (SELECT *, coalesce(t_sec - lag(t_sec) OVER (PARTITION BY id, g ORDER BY t_sec, sequence), 0) AS dt FROM s),
e AS (SELECT *, volts * amps * dt / 3.6e6 AS kwh FROM d),
m AS (SELECT id, CAST(g AS bigint) AS session, count(*) AS rows, min(t_sec) AS start, max(t_sec) AS "end", round((max(t_sec) - min(t_sec)) / 60.0, 2) AS minutes,
 round(CAST(coalesce(sum(CAST(CASE WHEN kwh < 0 THEN -kwh END AS DECIMAL(18,6))), 0) AS double), 3) AS kwh_in, round(CAST(coalesce(sum(CAST(CASE WHEN kwh > 0 THEN kwh END AS DECIMAL(18,6))), 0) AS double), 3) AS kwh_out,
 arg_min_null(soc, row(t_sec, sequence)) AS soc_start, arg_max_null(soc, row(t_sec, sequence)) AS soc_end,
 round(100.0 * sum(CASE WHEN amps < 0 THEN dt ELSE 0 END) / nullif(sum(dt), 0), 2) AS charging_pct, round(100.0 * sum(CASE WHEN amps > 0 THEN dt ELSE 0 END) / nullif(sum(dt), 0), 2) AS discharging_pct,
 round(100.0 * sum(CASE WHEN speed > 0 THEN dt ELSE 0 END) / nullif(sum(dt), 0), 2) AS motion_pct, round(100.0 * sum(CASE WHEN {GUN} THEN dt ELSE 0 END) / nullif(sum(dt), 0), 2) AS gun_pct,
 avg(CASE WHEN {GUN} THEN 1.0 ELSE 0.0 END) AS gun_share, avg(amps) AS mean_amps FROM e GROUP BY id, g HAVING count(*) >= 2)
"""
_ACT = "CASE WHEN gun_share > 0.5 AND mean_amps < 0 THEN 'CHARGING_ACTIVE' WHEN gun_share > 0.5 THEN 'CHARGING_IDLE' WHEN mean_amps > 0 THEN 'DISCHARGING_ACTIVE' ELSE 'DISCHARGING_IDLE' END"


def _metrics(spark, sf):
    df = E.mode_gap_sessions(tel(spark, sf).withColumn("mode", S.activity_state()), F.col("mode"))
    return E.session_metrics(df)


@query("session_metrics", _METRICS + 'SELECT id, session, rows, start, "end", minutes, kwh_in, kwh_out, soc_start, soc_end, charging_pct, discharging_pct, motion_pct, gun_pct FROM m')
def session_metrics(spark, sf):
    return _metrics(spark, sf).drop("gun_share", "mean_amps")


@query("session_activity", _METRICS + f"SELECT id, session, {_ACT} AS activity FROM m")
def session_activity(spark, sf):
    return _metrics(spark, sf).select("id", "session", E.session_activity().alias("activity"))


@query("drop_micro_sessions", _METRICS + 'SELECT id, row_number() OVER (PARTITION BY id ORDER BY start, session) AS number, start, "end" FROM m WHERE minutes >= 2')
def drop_micro_sessions(spark, sf):
    w = Window.partitionBy("id").orderBy("start", "session")
    return _metrics(spark, sf).where("minutes >= 2").select("id", F.row_number().over(w).alias("number"), "start", "end")


@query("glitch_soc_drop", _METRICS + f", a AS (SELECT *, {_ACT} AS activity FROM m) SELECT id, session, 'soc_drop_in_' || activity AS reason FROM a WHERE activity = 'CHARGING_ACTIVE' AND soc_start - soc_end > 0 OR activity = 'CHARGING_IDLE' AND soc_start - soc_end > 0.5")
def glitch_soc_drop(spark, sf):
    m = _metrics(spark, sf)
    return m.select("id", "session", E.glitch(E.session_activity(), F.col("soc_start") - F.col("soc_end")).alias("reason")).where("reason IS NOT NULL")


@query("session_crate", f"WITH s AS ({_SESS}) SELECT id, CAST(g AS bigint) AS session, round(avg(CASE WHEN volts * amps < 0 THEN CAST(volts * amps / 1000 AS DECIMAL(18,6)) END) / 423.96, 4) AS charge_c, round(avg(CASE WHEN volts * amps > 0 THEN CAST(volts * amps / 1000 AS DECIMAL(18,6)) END) / 423.96, 4) AS discharge_c FROM s GROUP BY id, g")
def session_crate(spark, sf):
    df = E.mode_gap_sessions(tel(spark, sf).withColumn("mode", S.activity_state()), F.col("mode"))
    kw = (F.col("volts") * F.col("amps") / 1000).cast("decimal(18,6)")
    rate = lambda cond: F.round(F.avg(F.when(cond, kw)).cast("double") / 423.96, 4)
    return df.groupBy("id", "session").agg(rate(F.col("volts") * F.col("amps") < 0).alias("charge_c"), rate(F.col("volts") * F.col("amps") > 0).alias("discharge_c"))


@query("missing_info_gaps", _METRICS + """, s2 AS (SELECT id, start // 86400 AS day, start AS s, least("end", (start // 86400 + 1) * 86400) AS e FROM m),
g AS (SELECT id, day, max(e) OVER w AS a, coalesce(lead(s) OVER (PARTITION BY id, day ORDER BY s, e), (day + 1) * 86400) AS b FROM s2 WINDOW w AS (PARTITION BY id, day ORDER BY s, e ROWS UNBOUNDED PRECEDING)
 UNION ALL SELECT id, day, day * 86400, min(s) FROM s2 GROUP BY id, day)
SELECT id, day, a AS start, b AS "end" FROM g WHERE b - a >= 120""")
def missing_info_gaps(spark, sf):
    m = _metrics(spark, sf).select("id", "start", F.least("end", (F.floor(F.col("start") / 86400) + 1) * 86400).alias("end"))
    return E.missing_gaps(m)


@query("charging_sessions_gun", "WITH p AS (SELECT *, coalesce((volts * amps / 1000 + lag(volts * amps / 1000) OVER ({o})) / 2 * (t_sec - lag(t_sec) OVER ({o})) / 3600.0, 0) AS area FROM tel), q AS (" + runs(GUN, of="p") + """),
r AS (SELECT id, g, min(t_sec) AS s, max(t_sec) AS e, arg_min_null(soc, row(t_sec, sequence)) AS s0, arg_max_null(soc, row(t_sec, sequence)) AS s1, sum(CAST(area AS DECIMAL(18,6))) AS kwh FROM q WHERE k GROUP BY id, g),
n AS (SELECT *, CASE WHEN s - lag(e) OVER w <= 60 OR s - lag(e) OVER w <= 300 AND abs(s0 - lag(s1) OVER w) <= 1 THEN 0 ELSE 1 END AS new FROM r WINDOW w AS (PARTITION BY id ORDER BY s)),
j AS (SELECT *, sum(new) OVER (PARTITION BY id ORDER BY s) AS session FROM n)
SELECT id, CAST(session AS bigint) AS session, min(s) AS start, max(e) AS "end", arg_min(s0, s) AS soc_start, arg_max(s1, s) AS soc_end, round(CAST(sum(kwh) AS double), 3) AS kwh, round(abs(arg_max(s1, s) - arg_min(s0, s)) / 100 * 423, 3) AS soc_kwh FROM j GROUP BY id, session""")
def charging_sessions_gun(spark, sf):
    return E.charging_sessions(tel(spark, sf), flag("gun"))


@query("soc_accuracy_sessions", f"""WITH s AS ({_SESS}), d AS (SELECT *, least(coalesce(t_sec - lag(t_sec) OVER (PARTITION BY id, g ORDER BY t_sec, sequence), 0), 60) AS dt FROM s),
m AS (SELECT id, g, min(k) AS mode, count(*) AS rows, count(CASE WHEN abs(amps) > 10 AND volts IS NOT NULL THEN 1 END) AS act, abs(arg_max_null(soc, row(t_sec, sequence)) - arg_min_null(soc, row(t_sec, sequence))) * avg(soh) * 423 / 1e4 AS soc,
 abs(CAST(sum(CAST(CASE WHEN abs(amps) > 10 THEN volts * amps * dt / 3.6e6 END AS DECIMAL(18,6))) AS double)) AS kwh FROM d GROUP BY id, g)
SELECT id, CAST(g AS bigint) AS session, mode, rows, round(soc, 3) AS soc_kwh, round(kwh, 3) AS measured_kwh, round(CASE WHEN soc > 0 THEN (1 - abs(soc - kwh) / soc) * 100 END, 2) AS accuracy_pct FROM m WHERE rows >= 2 AND act > 0""")
def soc_accuracy_sessions(spark, sf):
    return E.soc_accuracy_sessions(tel(spark, sf), S.activity_state())


@query("op_state_sessions", "SELECT id, CAST(g AS bigint) AS session, min(k) AS state, min(t_sec) AS start, max(t_sec) AS \"end\", arg_min(odo, row(t_sec, sequence)) AS odo_start, arg_max(odo, row(t_sec, sequence)) AS odo_end FROM (" + runs(f"CASE WHEN {GUN} THEN 'CHARGING' WHEN gear = 2 THEN 'DRIVING' WHEN gear = 0 AND ready = 1 AND ignition = 1 THEN 'IDLING' ELSE 'OFF' END") + ") WHERE k <> 'OFF' GROUP BY id, g")
def op_state_sessions(spark, sf):
    return E.op_state_sessions(tel(spark, sf), S.op_state())


_ALERT = f"coalesce((ready = 1 AND tmax > 28 OR {GUN} AND tmax > 28), false)"


@query("alert_periods", "WITH a AS (SELECT * FROM tel WHERE " + _ALERT + "), q AS (" + runs("1", "t_sec - pt > 120", "a") + f""")
SELECT id, CAST(g AS bigint) AS period, min(t_sec) AS start, max(t_sec) AS "end", count(*) AS rows, max(tmax) AS hottest, CASE WHEN max(CASE WHEN {GUN} THEN 1 ELSE 0 END) = 1 THEN 'charging' ELSE 'motion' END AS kind FROM q GROUP BY id, g HAVING max(t_sec) - min(t_sec) >= 300""")
def alert_periods(spark, sf):
    hot = F.coalesce((flag("ready") | flag("gun")) & (F.col("tmax") > 28), F.lit(False))
    return E.alert_periods(tel(spark, sf), hot)


@query("state_transitions", f"""WITH c AS (SELECT *, CASE WHEN {GUN} THEN 'cool' ELSE 'idle' END AS command FROM tel),
p AS (SELECT *, coalesce(lag(command) OVER ({{o}}), 'Unknown') AS prev_command, coalesce(lag(tms_mode) OVER ({{o}}), 'Unknown') AS prev_tms_mode FROM c)
SELECT id, sequence, prev_command, command, prev_tms_mode, tms_mode, CASE WHEN command <> prev_command AND tms_mode <> prev_tms_mode THEN 'both' WHEN command <> prev_command THEN 'cmd_only' ELSE 'mode_only' END AS kind FROM p WHERE command <> prev_command OR tms_mode <> prev_tms_mode""")
def state_transitions(spark, sf):
    df = tel(spark, sf).withColumn("command", F.when(flag("gun"), "cool").otherwise("idle"))
    return E.state_transitions(df).select("id", "sequence", "prev_command", "command", "prev_tms_mode", "tms_mode", "kind")


@query("tms_state_groups", "WITH x AS (SELECT *, coalesce(lead(t_sec) OVER ({o}) - t_sec, 0) AS nx FROM tel), q AS (" + runs("tms_mode", of="x") + """), c AS (SELECT id, g, tmax, count(*) AS n FROM q GROUP BY ALL), md AS (SELECT id, g, arg_min(tmax, row(-n, tmax)) AS t_mode FROM c GROUP BY id, g)
SELECT q.id, CAST(q.g AS bigint) AS "group", min(k) AS state, min(t_sec) AS start, max(t_sec) AS "end", count(*) AS rows, arg_min(tmax, row(t_sec, sequence)) AS t_start, arg_max(tmax, row(t_sec, sequence)) AS t_end, median(tmax) AS t_median, any_value(t_mode) AS t_mode,
 round(sum(CASE WHEN amps <> 0 THEN nx ELSE 0 END) / 60.0, 3) AS active_min FROM q JOIN md ON q.id = md.id AND q.g = md.g GROUP BY q.id, q.g""")
def tms_state_groups(spark, sf):
    return E.state_groups(tel(spark, sf), F.col("tms_mode"))


@query("cooling_response", """WITH e AS (SELECT *, min(CASE WHEN tmax < 35 THEN t_sec END) OVER ({o} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS x, coalesce(lag(tmax > 35) OVER ({o}), false) AS before FROM tel)
SELECT id, min(t_sec) AS entry, x AS exit, x - min(t_sec) AS seconds FROM e WHERE tmax > 35 AND NOT before AND x IS NOT NULL GROUP BY id, x""")
def cooling_response(spark, sf):
    return E.cooling_response(tel(spark, sf))


_STOPS = """WITH z AS (SELECT *, lag(speed) OVER ({o}) AS pv, min(CASE WHEN brake > 0 THEN t_sec END) OVER (PARTITION BY id ORDER BY t_sec RANGE BETWEEN 120 PRECEDING AND CURRENT ROW) AS st FROM tel),
h AS (SELECT id, t_sec AS stop, sequence AS sq, st FROM z WHERE speed = 0 AND pv > 0 AND st IS NOT NULL),
b AS (SELECT h.id, h.stop, h.st AS start, max(t.speed) AS peak_speed, arg_min(t.speed, row(t.t_sec, t.sequence)) AS start_speed, max(t.brake) AS max_brake, count(*) AS rows FROM h JOIN tel t ON t.id = h.id AND t.t_sec >= h.st AND (t.t_sec < h.stop OR t.t_sec = h.stop AND t.sequence <= h.sq) GROUP BY h.id, h.stop, h.sq, h.st HAVING max(t.speed) >= 30)
"""


@query("brake_stops", _STOPS + "SELECT * FROM b")
def brake_stops(spark, sf):
    return E.brake_stops(tel(spark, sf), search_sec=120)


@query("brake_metrics", _STOPS + "SELECT id, stop, round(peak_speed / 3.6 / nullif(stop - start, 0), 4) AS deceleration, round(13500 * (peak_speed / 3.6 / nullif(stop - start, 0)) / 9.80665, 2) AS force_kgf FROM b")
def brake_metrics(spark, sf):
    return E.brake_metrics(E.brake_stops(tel(spark, sf), search_sec=120)).select("id", "stop", "deceleration", "force_kgf")


@query("brake_runs", "WITH a AS (SELECT * FROM tel WHERE brake > 0), q AS (" + runs("1", "t_sec - pt > 120", "a") + """)
SELECT id, CAST(g AS bigint) AS run, min(t_sec) AS start, max(t_sec) AS "end", arg_min(speed, row(t_sec, sequence)) AS start_speed, min(speed) AS least_speed, count(*) AS rows FROM q GROUP BY id, g HAVING min(speed) = 0""")
def brake_runs(spark, sf):
    return E.brake_runs(tel(spark, sf), gap_sec=120)


def _hav(lat: float, lon: float) -> str:
    return f"round(2 * 6371000.0 * asin(sqrt(pow(sin((radians({lat}) - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(radians({lat})) * pow(sin(radians({lon} - lon) / 2), 2))), 1)"


_NEAR = "WITH near AS (SELECT *, least(" + ", ".join(f"row({_hav(a, b)}, '{label}')" for label, a, b in R.SITES) + ") AS nr FROM tel), n AS (SELECT * EXCLUDE (nr), CASE WHEN lat IS NOT NULL AND lon IS NOT NULL THEN nr[1] END AS site_m, CASE WHEN lat IS NOT NULL AND lon IS NOT NULL AND nr[1] <= 6000 THEN nr[2] ELSE 'NONE' END AS site FROM near) "


def _near(spark, sf):
    return R.nearest_site(tel(spark, sf), R.SITES, within_m=6000)


@query("geofence_nearest", _NEAR + "SELECT id, sequence, site, site_m FROM n")
def geofence_nearest(spark, sf):
    return _near(spark, sf).select("id", "sequence", "site", "site_m")


_STAY = _NEAR + ", w AS (SELECT * FROM n WHERE site <> 'NONE'), q AS (" + runs("site", of="w") + """),
st AS (SELECT id, CAST(g AS bigint) AS stay, min(k) AS site, min(t_sec) AS arrive, max(t_sec) AS depart, arg_max(odo, row(t_sec, sequence)) AS odo_out, arg_min(odo, row(t_sec, sequence)) AS odo_in, count(*) AS rows FROM q GROUP BY id, g)
"""


@query("proximity_stays", _STAY + "SELECT * FROM st")
def proximity_stays(spark, sf):
    return R.stays(_near(spark, sf))


@query("closest_in_stay", _NEAR + ", q AS (" + runs("site", of="n") + ") SELECT id, sequence, CASE WHEN site <> 'NONE' THEN row_number() OVER (PARTITION BY id, g ORDER BY site_m, t_sec, sequence) END AS site_rank FROM q")
def closest_in_stay(spark, sf):
    return R.closest_in_stay(_near(spark, sf)).select("id", "sequence", "site_rank")


_TRIP = _STAY + ", tr AS (SELECT *, lead(site) OVER w AS to_site, lead(arrive) OVER w AS reach, lead(odo_in) OVER w AS next_odo FROM st WINDOW w AS (PARTITION BY id ORDER BY arrive, stay)) "


@query("next_arrival_link", _TRIP + "SELECT id, stay, depart AS leave, reach, round(CASE WHEN next_odo - odo_out >= 0 THEN next_odo - odo_out END, 3) AS km FROM tr WHERE to_site IS NOT NULL")
def next_arrival_link(spark, sf):
    return R.trips(R.stays(_near(spark, sf))).select("id", "stay", "leave", "reach", "km")


@query("halt_join", _STAY + "SELECT id, stay, depart - arrive AS halt_sec FROM st")
def halt_join(spark, sf):
    return R.stays(_near(spark, sf)).select("id", "stay", (F.col("depart") - F.col("arrive")).alias("halt_sec"))


def _hms(x: str) -> str:
    return f"printf('%02d:%02d:%02d', ({x}) // 3600, ({x}) % 3600 // 60, ({x}) % 60)"


@query("trip_report", _TRIP + f"SELECT id, stay, site || ' - ' || to_site AS trip, {_hms('reach - depart')} AS travel, {_hms('depart - arrive')} AS halt, {_hms('reach - arrive')} AS total FROM tr WHERE to_site IS NOT NULL")
def trip_report(spark, sf):
    return R.trips(R.stays(_near(spark, sf))).select("id", "stay", "trip", "travel", "halt", "total")


_STEP = "(SELECT *, least(coalesce(t_sec - lag(t_sec) OVER ({o}), 0), 60) AS dt, speed - lag(speed) OVER ({o}) AS dv FROM tel)"


@query("trip_energy", _TRIP + f""", x AS (SELECT t.*, tr.stay, round(CASE WHEN next_odo - odo_out >= 0 THEN next_odo - odo_out END, 3) AS km, t.volts * t.amps / 1000 * t.dt / 3600 AS kwh FROM {_STEP} t JOIN tr ON t.id = tr.id AND tr.to_site IS NOT NULL AND t.t_sec BETWEEN tr.depart AND tr.reach),
s AS (SELECT id, stay, any_value(km) AS km, coalesce(CAST(sum(CASE WHEN kwh > 0 THEN CAST(kwh AS DECIMAL(18,6)) END) AS double), 0) AS used, coalesce(CAST(sum(CASE WHEN kwh < 0 AND dv < 0 THEN CAST(-kwh AS DECIMAL(18,6)) END) AS double), 0) * 0.8 AS regen, coalesce(CAST(sum(CASE WHEN kwh > 0 AND speed = 0 THEN CAST(kwh AS DECIMAL(18,6)) END) AS double), 0) AS idle FROM x GROUP BY id, stay)
SELECT id, stay, round(used, 3) AS used_kwh, round(regen, 3) AS regen_kwh, round(idle, 3) AS idle_kwh, round(CASE WHEN km >= 0.1 THEN (used - regen) / km ELSE 0 END, 3) AS kwh_per_km FROM s""")
def trip_energy(spark, sf):
    return R.trip_energy(tel(spark, sf), R.trips(R.stays(_near(spark, sf))))


@query("range_join_sessions", _ENV + ', w AS (SELECT id, envelope, min(s) AS s, max(e) AS e FROM v GROUP BY ALL) SELECT t.id, CAST(w.envelope AS bigint) AS envelope, count(*) AS rows, max(tmax) AS hottest FROM tel t JOIN w ON t.id = w.id AND t.t_sec BETWEEN w.s AND w.e GROUP BY ALL')
def range_join_sessions(spark, sf):
    df = tel(spark, sf)
    env = E.charging_envelopes(df.withColumn("mode", S.activity_state()))
    return R.rows_in_intervals(df, env).groupBy("id", "envelope").agg(F.count("*").alias("rows"), F.max("tmax").alias("hottest"))


@query("align_minute_rank_left", """WITH a AS (SELECT id, sequence, t_sec, t_sec // 60 AS minute, row_number() OVER (PARTITION BY id, t_sec // 60 ORDER BY t_sec, sequence) AS rn FROM tel),
b AS (SELECT id, lat, t_sec // 60 AS minute, row_number() OVER (PARTITION BY id, t_sec // 60 ORDER BY t_sec, sequence) AS rn FROM tel WHERE lat IS NOT NULL)
SELECT a.id, a.sequence, b.lat FROM a LEFT JOIN b ON a.id = b.id AND a.minute = b.minute AND a.rn = b.rn""")
def align_minute_rank_left(spark, sf):
    df = tel(spark, sf)
    left = df.select("id", "t_sec", "sequence", F.col("sequence").alias("seq"))
    out = R.align_minute_rank(left, df.where("lat IS NOT NULL").select("id", "t_sec", "sequence", "lat"))
    return out.select("id", F.col("seq").alias("sequence"), "lat")


@query("tolerance_join", "SELECT a.id, a.sequence, count(*) AS n FROM tel a JOIN tel b ON a.id = b.id AND abs(a.t_sec - b.t_sec) <= 40 WHERE a.gear = 2 AND b.brake > 0 GROUP BY ALL")
def tolerance_join(spark, sf):
    df = tel(spark, sf)
    a = df.where("gear = 2").select("id", "sequence", "t_sec")
    b = df.where("brake > 0").select("id", F.col("t_sec").alias("t_b"))
    return R.tolerance_join(a, b, 40, "t_sec", "t_b").groupBy("id", "sequence").agg(F.count("*").alias("n"))
