"""Queries: cleaning, fills and states over the telemetry view."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.functions.expressions import flag
from fleetlens.operators import states as S
from fleetlens.operators import timeseries as X
from fleetlens.plans.registry import query
from fleetlens.sources.telemetry import telemetry as tel

KEY = ("id", "sequence")
#: The view's flag test in SQL.
GUN = "coalesce(gun = 1, false)"


def _r(c: str, digits: int = 4):
    return F.round(F.col(c).cast("double"), digits).alias(c)


@query("dt_seconds", "SELECT id, sequence, CASE WHEN d > 60 THEN 0 ELSE d END AS dt FROM (SELECT *, CAST(coalesce(t_sec - lag(t_sec) OVER ({o}), 0) AS double) AS d FROM tel)")
def dt_seconds(spark, sf):
    return X.dt_seconds(tel(spark, sf), cap=60).select(*KEY, "dt")


@query("islands", "SELECT id, sequence, CAST(sum(n) OVER ({o}) AS bigint) AS island FROM (SELECT *, CASE WHEN gear IS NOT DISTINCT FROM lag(gear) OVER ({o}) AND lag(1) OVER ({o}) = 1 THEN 0 ELSE 1 END AS n FROM tel)")
def islands(spark, sf):
    return X.islands(tel(spark, sf), F.col("gear")).select(*KEY, "island")


@query("fill_forward_back", "SELECT id, sequence, coalesce(last_value(odo IGNORE NULLS) OVER ({o} {up}), first_value(odo IGNORE NULLS) OVER ({o} {down})) AS odo, coalesce(last_value(gun IGNORE NULLS) OVER ({o} {up}), first_value(gun IGNORE NULLS) OVER ({o} {down})) AS gun FROM tel")
def fill_forward_back(spark, sf):
    return X.fill_forward_back(tel(spark, sf), ["odo", "gun"]).select(*KEY, "odo", "gun")


@query("fill_forward_limited", "WITH n AS (SELECT *, row_number() OVER ({o}) AS rn FROM tel), k AS (SELECT *, last_value(odo IGNORE NULLS) OVER ({o} {up}) AS v, rn - last_value(CASE WHEN odo IS NOT NULL THEN rn END IGNORE NULLS) OVER ({o} {up}) AS since FROM n) SELECT id, sequence, CASE WHEN since <= 1 THEN v END AS odo FROM k")
def fill_forward_limited(spark, sf):
    return X.fill_forward_limited(tel(spark, sf), {"odo": 1}).select(*KEY, "odo")


_NEAR = """WITH n AS (SELECT *, row_number() OVER ({o}) AS rn FROM tel),
k AS (SELECT *, last_value(odo IGNORE NULLS) OVER ({o} {up}) AS v0, last_value(CASE WHEN odo IS NOT NULL THEN rn END IGNORE NULLS) OVER ({o} {up}) AS p0,
 last_value(CASE WHEN odo IS NOT NULL THEN t_sec END IGNORE NULLS) OVER ({o} {up}) AS t0, first_value(odo IGNORE NULLS) OVER ({o} {down}) AS v1,
 first_value(CASE WHEN odo IS NOT NULL THEN rn END IGNORE NULLS) OVER ({o} {down}) AS p1, first_value(CASE WHEN odo IS NOT NULL THEN t_sec END IGNORE NULLS) OVER ({o} {down}) AS t1 FROM n)
"""


@query("interp_linear_rows", _NEAR + """SELECT id, sequence, round(CASE WHEN odo IS NOT NULL THEN odo WHEN v0 IS NOT NULL AND v1 IS NOT NULL THEN CASE WHEN rn - p0 <= 10 OR p1 - rn <= 10 THEN v0 + (v1 - v0) * (rn - p0) / (p1 - p0) END
 WHEN v0 IS NULL AND p1 - rn <= 10 THEN v1 WHEN v1 IS NULL AND rn - p0 <= 10 THEN v0 END, 4) AS odo FROM k""")
def interp_linear_rows(spark, sf):
    return X.interpolate(tel(spark, sf), "odo", limit=10).select(*KEY, _r("odo"))


@query("interp_linear_gap", _NEAR + """SELECT id, sequence, round(CASE WHEN odo IS NOT NULL THEN odo WHEN v0 IS NOT NULL AND v1 IS NOT NULL AND t1 - t0 <= 300 THEN v0 + (v1 - v0) * (rn - p0) / (p1 - p0) END, 4) AS odo FROM k""")
def interp_linear_gap(spark, sf):
    return X.interpolate(tel(spark, sf), "odo", max_gap=300, edges=False).select(*KEY, _r("odo"))


@query("interp_linear_time", _NEAR + "SELECT id, sequence, round(CASE WHEN odo IS NOT NULL THEN odo WHEN v0 IS NULL THEN v1 WHEN v1 IS NULL THEN v0 ELSE v0 + (v1 - v0) * (t_sec - t0) / (t1 - t0) END, 4) AS odo FROM k")
def interp_linear_time(spark, sf):
    return X.interpolate(tel(spark, sf), "odo", by="time").select(*KEY, _r("odo"))


@query("impute_odo_speed", """WITH d AS (SELECT *, CASE WHEN t_sec - lag(t_sec) OVER ({o}) <= 60 THEN coalesce(speed, 0) * (t_sec - lag(t_sec) OVER ({o})) / 3600.0 ELSE 0 END AS step, count(odo) OVER ({o} {up}) AS g,
 last_value(odo IGNORE NULLS) OVER ({o} {up}) AS l, first_value(odo IGNORE NULLS) OVER ({o} {down}) AS r FROM tel),
s AS (SELECT *, sum(CASE WHEN odo IS NULL THEN step ELSE 0 END) OVER (PARTITION BY id, g ORDER BY t_sec, sequence {up}) AS run FROM d)
SELECT id, sequence, round(CASE WHEN odo IS NOT NULL THEN odo WHEN l IS NULL THEN r WHEN r IS NULL THEN l WHEN r < l THEN l ELSE least(l + run, r) END + 0.000001, 2) AS odo FROM s""")
def impute_odo_speed(spark, sf):
    return X.impute_odo_speed(tel(spark, sf), dt_cap=60, digits=9).select(*KEY, F.round(F.col("odo") + 0.000001, 2).alias("odo"))


@query("odo_monotone", "SELECT id, sequence, max(odo) OVER ({o} {up}) AS odo FROM tel")
def odo_monotone(spark, sf):
    return X.odo_monotone(tel(spark, sf)).select(*KEY, "odo")


@query("clamp_current", "SELECT id, sequence, coalesce(last_value(CASE WHEN abs(amps) <= 1250 THEN amps END IGNORE NULLS) OVER ({o} {up}), 0) AS amps FROM tel")
def clamp_current(spark, sf):
    return X.clamp_current(tel(spark, sf)).select(*KEY, "amps")


@query("null_out_current", _NEAR.replace("odo", "amps").replace("FROM tel)", "FROM (SELECT id, sequence, t_sec, CASE WHEN abs(amps) <= 1000 THEN amps END AS amps FROM tel))", 1) + """, f AS (SELECT *, CASE WHEN amps IS NOT NULL THEN amps WHEN v0 IS NOT NULL AND v1 IS NOT NULL THEN CASE WHEN rn - p0 <= 30 OR p1 - rn <= 30 THEN v0 + (v1 - v0) * (rn - p0) / (p1 - p0) END
 WHEN v0 IS NULL AND p1 - rn <= 30 THEN v1 WHEN v1 IS NULL AND rn - p0 <= 30 THEN v0 END AS x FROM k)
SELECT id, sequence, round(coalesce(last_value(x IGNORE NULLS) OVER ({o} {up}), first_value(x IGNORE NULLS) OVER ({o} {down})), 4) AS amps FROM f""")
def null_out_current(spark, sf):
    return X.null_out_current(tel(spark, sf)).select(*KEY, _r("amps"))


@query("normalize_flag", f"SELECT id, sequence, {GUN} AS gun, ready = 1 AS ready FROM tel")
def normalize_flag(spark, sf):
    return tel(spark, sf).select(*KEY, flag("gun").alias("gun"), flag("ready", ("ready",)).alias("ready"))


@query("charge_mode", f"SELECT id, CASE WHEN {GUN} THEN 'CHARGING' ELSE 'DISCHARGING' END AS mode, count(*) AS n FROM tel GROUP BY ALL")
def charge_mode(spark, sf):
    return tel(spark, sf).groupBy("id", S.charge_mode().alias("mode")).agg(F.count("*").alias("n"))


@query("sanitize_ranges", """SELECT id, sequence, CASE WHEN tmax >= -10 THEN tmax END AS tmax, CASE WHEN volts > 0 THEN volts END AS volts, CASE WHEN soc <> 0 THEN soc END AS soc,
 CASE WHEN tmax_no BETWEEN 1 AND 108 THEN tmax_no END AS tmax_no, CASE WHEN vmax_no BETWEEN 1 AND 576 THEN vmax_no END AS vmax_no FROM tel""")
def sanitize_ranges(spark, sf):
    return S.sanitize_ranges(tel(spark, sf)).select(*KEY, "tmax", "volts", "soc", "tmax_no", "vmax_no")


@query("sentinel_null", "SELECT id, sequence, nullif(tmax, -40) AS tmax FROM tel WHERE nullif(tmax, -40) IS NOT NULL AND amps IS NOT NULL")
def sentinel_null(spark, sf):
    return S.sentinel_null(tel(spark, sf), ["tmax"], -40, ["tmax", "amps"]).select(*KEY, "tmax")


@query("drop_sentinel_current", "SELECT id, sequence, amps FROM tel WHERE amps IS NULL OR abs(amps) <> 3200")
def drop_sentinel_current(spark, sf):
    return S.drop_sentinel_current(tel(spark, sf)).select(*KEY, "amps")


@query("dedup_positive_dt", "SELECT id, sequence FROM (SELECT *, t_sec - lag(t_sec) OVER ({o}) AS d FROM tel) WHERE d IS NULL OR d > 0")
def dedup_positive_dt(spark, sf):
    return S.dedup_positive_dt(tel(spark, sf)).select(*KEY)


@query("state_consistency", f"""WITH f AS (SELECT *, {GUN} AS g, ready = 1 AND NOT {GUN} AS r, ignition = 1 OR {GUN} AS i FROM tel)
SELECT id, sequence, CAST(g AS int) AS gun, CAST(r AS int) AS ready, CAST(i AS int) AS ignition, CASE WHEN g OR NOT r OR NOT i THEN 0 ELSE gear END AS gear,
 CASE WHEN speed IS NULL AND (g OR NOT (r OR i) OR (r AND NOT i)) THEN 0 ELSE speed END AS speed FROM f""")
def state_consistency(spark, sf):
    return S.state_consistency(tel(spark, sf)).select(*KEY, "gun", "ready", "ignition", "gear", "speed")


@query("alt_mode", f"""SELECT id, sequence, CASE WHEN {GUN} AND amps < -5 THEN 'CHARGING_ACTIVE' WHEN {GUN} AND amps >= -5 THEN 'CHARGING_IDLE'
 WHEN NOT {GUN} AND speed > 0.5 AND gear IN (1, 2) THEN 'DISCHARGING_ACTIVE' ELSE 'DISCHARGING_IDLE' END AS mode FROM tel""")
def alt_mode(spark, sf):
    return tel(spark, sf).select(*KEY, S.alt_mode().alias("mode"))


@query("activity_state", f"""SELECT id, sequence, CASE WHEN {GUN} AND amps <= -5 THEN 'CHARGING_ACTIVE' WHEN {GUN} THEN 'CHARGING_IDLE' WHEN amps >= 5 THEN 'DISCHARGING_ACTIVE' ELSE 'DISCHARGING_IDLE' END AS mode FROM tel""")
def activity_state(spark, sf):
    return tel(spark, sf).select(*KEY, S.activity_state().alias("mode"))


@query("op_state", f"SELECT id, sequence, CASE WHEN {GUN} THEN 'CHARGING' WHEN gear = 2 THEN 'DRIVING' WHEN gear = 0 AND ready = 1 AND ignition = 1 THEN 'IDLING' ELSE 'OFF' END AS state FROM tel")
def op_state(spark, sf):
    return tel(spark, sf).select(*KEY, S.op_state().alias("state"))


@query("temp_status", "SELECT id, CASE WHEN tmin BETWEEN 20 AND 35 AND tmax BETWEEN 20 AND 35 THEN 'SAFE' ELSE 'EVALUATE' END AS status, count(*) AS n FROM tel GROUP BY ALL")
def temp_status(spark, sf):
    return tel(spark, sf).groupBy("id", S.temp_status().alias("status")).agg(F.count("*").alias("n"))


@query("lv_off_masks", f"SELECT id, sequence, ignition = 1 AND NOT {GUN} AND ready <> 1 AS lv, ignition <> 1 AND NOT {GUN} AND ready <> 1 AS off, ready = 1 AS is_ready, {GUN} AS is_gun FROM tel")
def lv_off_masks(spark, sf):
    return S.masks(tel(spark, sf)).select(*KEY, "lv", "off", "is_ready", "is_gun")


_ANOMALY = """SELECT *, coalesce(abs(odo - lag(odo) OVER ({o})) < 0.01 AND speed > 5 AND t_sec - lag(t_sec) OVER ({o}) > 10, false) AS odo_stuck,
 coalesce(CASE WHEN speed > 0.1 THEN volts * amps / 1000 > 0 AND NOT (volts * amps / 1000 / speed BETWEEN 0.1 AND 5) END, false) AS unrealistic_efficiency,
 coalesce(abs(amps) > 5 * abs(median(amps) OVER ({o} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)), false) AS current_spike FROM tel"""


@query("anomaly_flags", f"SELECT id, sequence, odo_stuck, unrealistic_efficiency, current_spike FROM ({_ANOMALY})")
def anomaly_flags(spark, sf):
    return S.anomaly_flags(tel(spark, sf)).select(*KEY, "odo_stuck", "unrealistic_efficiency", "current_spike")


@query("quality_filter", f"SELECT id, count(*) AS n FROM ({_ANOMALY}) WHERE abs(amps) <= 2000 AND odo IS NOT NULL AND soc IS NOT NULL AND NOT odo_stuck AND NOT unrealistic_efficiency AND NOT current_spike GROUP BY id")
def quality_filter(spark, sf):
    return S.quality_filter(S.anomaly_flags(tel(spark, sf))).groupBy("id").agg(F.count("*").alias("n"))


_JUMP = f"""SELECT *, concat_ws(';', CASE WHEN abs(d) >= 2 THEN 'jump' END, CASE WHEN NOT {GUN} AND dt > 0 AND abs(d) / dt > 0.1 THEN 'fast_driving' END, CASE WHEN {GUN} AND dt > 0 AND abs(d) / dt > 0.6 THEN 'fast_charging' END, CASE WHEN NOT {GUN} AND d > 0 THEN 'rise_not_charging' END) AS jump_reason
 FROM (SELECT *, soc - lag(soc) OVER ({{o}}) AS d, t_sec - lag(t_sec) OVER ({{o}}) AS dt FROM tel)"""


@query("soc_jump_flags", f"SELECT id, sequence, jump_reason, jump_reason <> '' AS soc_jump FROM ({_JUMP})")
def soc_jump_flags(spark, sf):
    return S.soc_jump_flags(tel(spark, sf)).select(*KEY, "jump_reason", "soc_jump")


@query("soc_clean", f"SELECT id, sequence, last_value(CASE WHEN jump_reason = '' THEN soc END IGNORE NULLS) OVER ({{o}} {{up}}) AS soc FROM ({_JUMP})")
def soc_clean(spark, sf):
    return S.soc_clean(S.soc_jump_flags(tel(spark, sf))).select(*KEY, "soc")


@query("tms_alert_condition", f"SELECT id, sequence, coalesce((ready = 1 AND tmax > 35 OR {GUN} AND tmax > 30) AND tms_mode = 'Off', false) AS alert FROM tel")
def tms_alert_condition(spark, sf):
    return tel(spark, sf).select(*KEY, S.tms_alert().alias("alert"))
