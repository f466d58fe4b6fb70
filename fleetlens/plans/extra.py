"""Queries: enriched sessions, dead reckoning, stops to stops, storage rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.operators import enrich as N
from fleetlens.operators import quality as Q
from fleetlens.operators import sessions as E
from fleetlens.operators import states as S
from fleetlens.operators import sweeps as W
from fleetlens.operators import trips as R
from fleetlens.operators.timeseries import series
from fleetlens.plans import sessions
from fleetlens.plans.registry import query
from fleetlens.plans.sequences import CHUNK, SENSOR_CYCLES
from fleetlens.plans.series import GUN
from fleetlens.plans.sessions import _METRICS, _NEAR, _SESS, runs
from fleetlens.sources.telemetry import telemetry as tel


@query("enrich_sessions", f"""WITH s AS ({_SESS}), d AS (SELECT *, coalesce(t_sec - lag(t_sec) OVER w, 0) AS dt, last_value(odo IGNORE NULLS) OVER (PARTITION BY id, g ORDER BY t_sec, sequence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS po FROM s WINDOW w AS (PARTITION BY id, g ORDER BY t_sec, sequence)),
e AS (SELECT *, volts * amps / 1000 * dt / 3600 AS kwh FROM d),
m AS (SELECT id, g, arg_max(odo, row(t_sec, sequence)) - arg_min(odo, row(t_sec, sequence)) AS net, coalesce(CAST(sum(CAST(greatest(coalesce(odo - po, 0), 0) AS DECIMAL(18,6))) AS double), 0) AS fwd, median(CASE WHEN speed > 0.1 THEN speed END) AS mm, max(speed) AS sm, quantile_cont((vmax - vmin) * 1000, 0.95) AS dv, max(tmax - tmin) AS sp,
 coalesce(CAST(sum(CASE WHEN kwh > 0 THEN CAST(kwh AS DECIMAL(18,6)) END) AS double), 0) AS used, coalesce(CAST(sum(CASE WHEN kwh < 0 THEN CAST(-kwh AS DECIMAL(18,6)) END) AS double), 0) AS regen, sum(dt) / 3600.0 * 120 AS bound FROM e GROUP BY id, g),
k AS (SELECT *, CASE WHEN net > 1.3 * bound THEN bound WHEN net < 0 THEN fwd ELSE coalesce(net, 0) END AS km FROM m)
SELECT id, CAST(g AS bigint) AS session, round(km, 3) AS km, round(fwd, 3) AS forward_km, concat_ws(';', CASE WHEN net > 1.3 * bound THEN 'beyond_physics' END, CASE WHEN net < 0 THEN 'odometer_back' END) AS reasons, mm AS moving_median, sm AS speed_max, round(dv, 3) AS dv_p95, sp AS spread_max,
 round(CASE WHEN km > 0 THEN used / km ELSE 0 END, 3) AS kwh_per_km, round(CASE WHEN km > 20 THEN (used - regen) / km ELSE 0 END, 3) AS net_kwh_per_km FROM k""")
def enrich_sessions(spark, sf):
    return N.enrich_sessions(E.mode_gap_sessions(tel(spark, sf).withColumn("mode", S.activity_state()), F.col("mode")))


@query("impute_odo_deadreckon", """WITH d AS (SELECT *, CASE WHEN t_sec - lag(t_sec) OVER ({o}) <= 60 THEN coalesce(speed, 0) * (t_sec - lag(t_sec) OVER ({o})) / 3600.0 ELSE 0 END AS step, count(odo) OVER ({o} {up}) AS g, last_value(odo IGNORE NULLS) OVER ({o} {up}) AS l FROM tel)
SELECT id, sequence, round(coalesce(odo, l + sum(CASE WHEN odo IS NULL THEN step ELSE 0 END) OVER (PARTITION BY id, g ORDER BY t_sec, sequence {up})) + 0.000001, 2) AS odo FROM d""")
def impute_odo_deadreckon(spark, sf):
    return N.impute_odo_deadreckon(tel(spark, sf)).select("id", "sequence", F.round(F.col("odo") + 0.000001, 2).alias("odo"))


@query("gps_deadreckon", """WITH RECURSIVE a AS (SELECT id, sequence, lat, lon, row_number() OVER ({o}) AS n, coalesce(speed, 0) / 3.6 * greatest(coalesce(t_sec - lag(t_sec) OVER ({o}), 0), 0) / 6371000.0 AS s, CASE WHEN lat IS NOT NULL AND lon IS NOT NULL THEN {'lat': lat, 'lon': lon} END AS fix FROM tel),
b AS (SELECT *, first_value(fix IGNORE NULLS) OVER (PARTITION BY id ORDER BY n ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM a),
c AS (SELECT *, CASE WHEN fix IS NOT NULL AND nxt IS NOT NULL THEN atan2(sin(radians(nxt.lon - lon)) * cos(radians(nxt.lat)), cos(radians(lat)) * sin(radians(nxt.lat)) - sin(radians(lat)) * cos(radians(nxt.lat)) * cos(radians(nxt.lon - lon))) END AS bearing FROM b),
r AS (SELECT id, n, radians(fix.lat) AS p, radians(fix.lon) AS q, bearing FROM c WHERE n = 1
      UNION ALL SELECT id, n, CASE WHEN fix IS NOT NULL THEN radians(fix.lat) ELSE p2 END, CASE WHEN fix IS NOT NULL THEN radians(fix.lon) ELSE q + atan2(sin(bearing) * sin(s) * cos(p), cos(s) - sin(p) * sin(p2)) END, CASE WHEN fix IS NOT NULL THEN own ELSE bearing END
      FROM (SELECT c.id, c.n, c.fix, c.s, c.bearing AS own, r.p, r.q, r.bearing, asin(sin(p) * cos(s) + cos(p) * sin(s) * cos(r.bearing)) AS p2 FROM r JOIN c ON c.id = r.id AND c.n = r.n + 1))
SELECT c.id, sequence, round(CASE WHEN fix IS NULL AND nxt IS NOT NULL AND p IS NOT NULL THEN degrees(p) ELSE lat END, 6) AS lat, round(CASE WHEN fix IS NULL AND nxt IS NOT NULL AND p IS NOT NULL THEN degrees(q) ELSE lon END, 6) AS lon FROM c JOIN r ON r.id = c.id AND r.n = c.n""")
def gps_deadreckon(spark, sf):
    """Gaps are folded by themselves; the SQL goes from sample to sample."""
    return N.gps_deadreckon(tel(spark, sf)).select("id", "sequence", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


@query("stop_to_stop_trips", _NEAR + ", q AS (" + runs("CASE WHEN speed = 0 AND site <> 'NONE' THEN site ELSE 'ON_ROAD' END", of="n") + """), r AS (SELECT id, g, min(k) AS place, min(t_sec) AS start, max(t_sec) AS "end", count(*) AS rows FROM q GROUP BY id, g),
l AS (SELECT *, lag(place) OVER w AS origin, lead(place) OVER w AS target FROM r WINDOW w AS (PARTITION BY id ORDER BY g))
SELECT id, CAST(g AS bigint) AS run, origin, target, start, "end", rows FROM l WHERE place = 'ON_ROAD' AND origin <> 'ON_ROAD' AND target <> 'ON_ROAD' AND origin <> target""")
def stop_to_stop_trips(spark, sf):
    return N.stop_to_stop_trips(sessions._near(spark, sf))


@query("window_energy", _METRICS + """, x AS (SELECT t.id, m.session, t.volts * t.amps / 1000 * least(coalesce(t.d, 0), 60) / 3600 AS kwh FROM (SELECT *, t_sec - lag(t_sec) OVER ({o}) AS d FROM tel) t JOIN m ON t.id = m.id AND t.t_sec BETWEEN m.start AND m."end" AND m.minutes >= 2)
SELECT id, session, round(coalesce(CAST(sum(CASE WHEN kwh > 0 THEN CAST(kwh AS DECIMAL(18,6)) END) AS double), 0), 3) AS used, count(*) AS rows FROM x GROUP BY id, session""")
def window_energy(spark, sf):
    """Energy of any list of (vehicle, start, end)."""
    df = tel(spark, sf).withColumn("d", F.least(F.coalesce(F.col("t_sec") - F.lag("t_sec").over(series()), F.lit(0)), F.lit(60)))
    rows = R.rows_in_intervals(df, sessions._metrics(spark, sf).where("minutes >= 2").select("id", "session", "start", "end"))
    kwh = F.col("volts") * F.col("amps") / 1000 * F.col("d") / 3600
    return rows.groupBy("id", "session").agg(F.round(F.coalesce(F.sum(F.when(kwh > 0, kwh).cast("decimal(18,6)")).cast("double"), F.lit(0.0)), 3).alias("used"), F.count("*").alias("rows"))


@query("drive_charge_idle", f"SELECT id, CASE WHEN {GUN} THEN 'Charging-Park' WHEN speed > 0 THEN 'Drive' ELSE 'Idle-Other' END AS state, count(*) AS n FROM tel GROUP BY ALL")
def drive_charge_idle(spark, sf):
    return tel(spark, sf).groupBy("id", N.drive_charge_idle().alias("state")).agg(F.count("*").alias("n"))


@query("sweep_values", SENSOR_CYCLES + """ SELECT cy.id, cycle, ra.s[1] AS sensor, arg_max(ra.tmax, row(ra.t_sec, ra.sequence)) AS value FROM cy JOIN ra ON ra.id = cy.id AND ra.t_sec BETWEEN cy.start AND cy."end" WHERE ra.tmax IS NOT NULL GROUP BY ALL""")
def sweep_values(spark, sf):
    df = tel(spark, sf).withColumn("sensor", F.col("tmax_no") % 8)
    return N.sweep_values(df, W.sweep_cycles(df, 8, chunk_sec=CHUNK), "sensor", "tmax")


@query("comissing_pairs", "WITH f AS (SELECT CAST(lat IS NULL AS int) AS a, CAST(lon IS NULL AS int) AS b FROM tel) SELECT 'lat' AS a, 'lon' AS b, round(corr(f.a, f.b), 6) AS r FROM f")
def comissing_pairs(spark, sf):
    return N.comissing_pairs(tel(spark, sf), ["lat", "lon", "odo", "amps"])


@query("apply_storage_scaling", "SELECT id, sequence, CAST(round_even(odo * 1000, 0) AS bigint) AS odo, CAST(round_even(vmax * 1000, 0) AS int) AS vmax, CAST(tmax_no AS smallint) AS tmax_no FROM tel")
def apply_storage_scaling(spark, sf):
    return N.apply_storage_scaling(tel(spark, sf), ["odo", "vmax", "tmax_no"]).select("id", "sequence", "odo", "vmax", "tmax_no")


@query("profile_with_bounds", "WITH x AS (SELECT * FROM tel) " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", min({c}) AS least, max({c}) AS most, {lo} AS lo, {hi} AS hi, min({c}) < {lo} OR max({c}) > {hi} AS beyond FROM x" for c, lo, hi in (("soc", "0.0", "100.0"), ("tmax", "-10.0", "80.0"), ("volts", "400.0", "800.0"))))
def profile_with_bounds(spark, sf):
    """Profiles beside what the signal's dictionary allows."""
    bounds = spark.createDataFrame([("soc", 0.0, 100.0), ("tmax", -10.0, 80.0), ("volts", 400.0, 800.0)], "column string, lo double, hi double")
    p = Q.profile_numeric(tel(spark, sf), ["soc", "tmax", "volts"]).join(F.broadcast(bounds), "column", "left")
    return p.select("column", "least", "most", "lo", "hi", ((F.col("least") < F.col("lo")) | (F.col("most") > F.col("hi"))).alias("beyond"))


@query("fleet_energy_summary", _METRICS + f", a AS (SELECT CASE WHEN gun_share > 0.5 THEN 'CHARGING' ELSE 'DISCHARGING' END AS mode, * FROM m) SELECT coalesce(mode, 'ALL') AS mode, round(sum(CAST(kwh_in AS DECIMAL(18,3))), 3) AS kwh_in, round(sum(CAST(kwh_out AS DECIMAL(18,3))), 3) AS kwh_out, count(*) AS sessions FROM a GROUP BY ROLLUP (mode)")
def fleet_energy_summary(spark, sf):
    """Each mode and all of them, from one pass."""
    m = sessions._metrics(spark, sf).withColumn("mode", F.when(F.col("gun_share") > 0.5, "CHARGING").otherwise("DISCHARGING"))
    total = lambda c: F.round(F.sum(F.col(c).cast("decimal(18,3)")).cast("double"), 3).alias(c)
    return m.rollup("mode").agg(total("kwh_in"), total("kwh_out"), F.count("*").alias("sessions")).na.fill("ALL", ["mode"])


_CONTACTOR = "CASE WHEN sequence % 19 = 0 THEN NULL WHEN gun = 1 AND sequence % 7 <> 3 THEN 1 ELSE 0 END"


@query("charging_sessions_contactor", f"""WITH c0 AS (SELECT *, {_CONTACTOR} AS k0, nullif(soc, 0) AS soc0, nullif(volts, 0) AS volts0 FROM tel WHERE abs(amps) IS DISTINCT FROM 3200),
c1 AS (SELECT id, t_sec, sequence, gun, k0, coalesce(amps, 0) AS amps, coalesce(last_value(soc0 IGNORE NULLS) OVER ({{o}} {{up}}), first_value(soc0 IGNORE NULLS) OVER ({{o}} {{down}})) AS soc, coalesce(last_value(volts0 IGNORE NULLS) OVER ({{o}} {{up}}), first_value(volts0 IGNORE NULLS) OVER ({{o}} {{down}})) AS volts FROM c0),
p AS (SELECT * FROM c1 WHERE soc IS NOT NULL AND volts IS NOT NULL AND k0 IS NOT NULL), q AS ({runs("k0 = 1", of="p")}),
r AS (SELECT id, g, min(t_sec) AS s, max(t_sec) AS e, arg_min(soc, row(t_sec, sequence)) AS s0, arg_max(soc, row(t_sec, sequence)) AS s1 FROM q WHERE k GROUP BY id, g),
n AS (SELECT *, CASE WHEN s - lag(e) OVER w <= 60 OR s - lag(e) OVER w <= 300 AND abs(s0 - lag(s1) OVER w) <= 1 THEN 0 ELSE 1 END AS new FROM r WINDOW w AS (PARTITION BY id ORDER BY s)),
j AS (SELECT *, sum(new) OVER (PARTITION BY id ORDER BY s) AS session FROM n),
f AS (SELECT id, CAST(session AS bigint) AS session, min(s) AS start, max(e) AS "end", arg_min(s0, s) AS soc_start, arg_max(s1, s) AS soc_end FROM j GROUP BY id, session HAVING arg_min(s0, s) <> arg_max(s1, s)),
x AS (SELECT f.id, f.session, p.t_sec, p.soc, (volts * abs(amps) + lag(volts * abs(amps)) OVER w) / 2000 * (p.t_sec - lag(p.t_sec) OVER w) / 3600.0 AS kwh FROM f JOIN p ON p.id = f.id AND p.gun = 1 AND p.t_sec BETWEEN f.start AND f."end" WINDOW w AS (PARTITION BY f.id, f.session ORDER BY p.t_sec, p.sequence)),
y AS (SELECT id, session, max(t_sec) - min(t_sec) AS seconds, min(CASE WHEN soc >= 80 THEN t_sec END) - min(t_sec) AS full_sec, CAST(sum(CAST(kwh AS DECIMAL(18,6))) AS double) AS kwh FROM x GROUP BY id, session),
z AS (SELECT f.*, coalesce(seconds, 0) AS seconds, CASE WHEN soc_end >= 80 THEN full_sec END AS full_sec, coalesce(kwh, 0) AS kwh, (soc_end - soc_start) * 423 / 100 AS soc_kwh FROM f LEFT JOIN y ON y.id = f.id AND y.session = f.session)
SELECT id, session, start, "end", soc_start, soc_end, seconds, full_sec, round(kwh, 3) AS kwh, round(soc_kwh, 3) AS soc_kwh, round(CASE WHEN kwh + soc_kwh <> 0 THEN 100 * abs(kwh - soc_kwh) / ((kwh + soc_kwh) / 2) ELSE 0 END, 2) AS apart_pct FROM z""")
def charging_sessions_contactor(spark, sf):
    """The view has no contactors: one is made of the gun, open now and then. Its charge counts as full at 80."""
    return E.charging_by_contactor(tel(spark, sf).withColumn("contactor", F.expr(_CONTACTOR)), "contactor", full=80)


@query("gap_status", "WITH g AS (SELECT id, sequence AS gap, lag(t_sec) OVER ({o}) AS start, t_sec AS \"end\" FROM tel), h AS (SELECT * FROM g WHERE \"end\" - start > 500), r AS (SELECT h.id, gap, count(DISTINCT t.sequence % 16) AS beats, max(t.sequence % 16) - min(t.sequence % 16) AS rg FROM h JOIN tel t ON t.id = h.id AND t.t_sec BETWEEN h.start AND h.\"end\" GROUP BY h.id, gap) SELECT id, gap, beats, CASE WHEN beats <= 1 THEN 'frozen' WHEN rg < 5 THEN 'sluggish' ELSE 'active_but_mute' END AS status FROM r")
def gap_status(spark, sf):
    df = tel(spark, sf).withColumn("beat", F.col("sequence") % 16)
    gaps = df.select("id", F.col("sequence").alias("gap"), F.lag("t_sec").over(series()).alias("start"), F.col("t_sec").alias("end")).where(F.col("end") - F.col("start") > 500)
    return N.gap_status(df, gaps)
