"""Queries: scans, fleet reports, thermal figures, and what is built on sessions and stops."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from fleetlens.functions import expressions as X
from fleetlens.functions.expressions import flag, haversine_m
from fleetlens.operators import buckets as B
from fleetlens.operators import quality as Q
from fleetlens.operators import sessions as E
from fleetlens.operators import states as S
from fleetlens.operators import sweeps as W
from fleetlens.operators import trips as R
from fleetlens.operators.quantiles import with_quantiles
from fleetlens.operators.timeseries import series, step_seconds
from fleetlens.plans import reports, sessions
from fleetlens.plans.registry import query
from fleetlens.plans.series import GUN
from fleetlens.plans.sessions import _ENV, _METRICS, _STOPS, MODE, runs
from fleetlens.sources import telemetry as src
from fleetlens.sources.telemetry import telemetry as tel


def events(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet")


@query("scan_local_day", "SELECT event_id, user_id FROM events WHERE CAST(ts + INTERVAL 330 MINUTE AS DATE) = DATE '2024-01-10'")
def scan_local_day(spark, sf):
    return src.scan_local_day(events(spark, sf), "2024-01-10").select("event_id", "user_id")


@query("scan_utc_window", "SELECT event_id, user_id FROM events WHERE ts >= TIMESTAMP '2024-01-09 18:30:00' AND ts < TIMESTAMP '2024-01-12 18:30:00'")
def scan_utc_window(spark, sf):
    return src.scan_utc_window(events(spark, sf), "2024-01-10", 3).select("event_id", "user_id")


@query("scan_date_range", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE CAST(l_shipdate AS DATE) BETWEEN DATE '1995-01-01' AND DATE '1995-01-07'")
def scan_date_range(spark, sf):
    items = spark.read.parquet(f"{sf}/lineitem.parquet").withColumn("dt", F.to_date("l_shipdate"))
    return src.scan_date_range(items, "1995-01-01", days=7).select("l_orderkey", "l_linenumber")


@query("scan_distinct_ids", "SELECT DISTINCT user_id FROM events WHERE user_id IN (SELECT c_custkey FROM customer)")
def scan_distinct_ids(spark, sf):
    ids = spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_custkey").alias("user_id"))
    return src.scan_distinct_ids(events(spark, sf), ids, "user_id")


@query("scan_parquet_window", "SELECT event_id, value FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-06'")
def scan_parquet_window(spark, sf):
    return src.scan_parquet_window(spark, f"{sf}/events.parquet", ["event_id", "value"], "2024-01-05", "2024-01-06")


@query("typed_projection", "SELECT event_id, CAST(value AS float) AS value, TRY_CAST(event_type AS int) AS event_type FROM events")
def typed_projection(spark, sf):
    return src.typed_projection(events(spark, sf), {"event_id": "UNMAPPED", "value": "float", "event_type": "int"})


@query("rename_signals", "SELECT event_id AS sequence, user_id AS id FROM events")
def rename_signals(spark, sf):
    return src.rename_signals(events(spark, sf), {"event_id": "sequence", "user_id": "id", "absent": "x"}).select("sequence", "id")


@query("round_cols", "SELECT event_id, round(value, 2) AS value FROM events")
def round_cols(spark, sf):
    return events(spark, sf).select("event_id", F.round("value", 2).alias("value"))


@query("order_by", "SELECT user_id, event_id FROM events")
def order_by(spark, sf):
    return events(spark, sf).select("user_id", "event_id").orderBy("user_id", "event_id")


@query("limit_n", "SELECT event_type, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, event_type LIMIT 3")
def limit_n(spark, sf):
    """The three commonest types: a top-k report."""
    return events(spark, sf).groupBy("event_type").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "event_type").limit(3)


@query("schema_summary", "SELECT 'value' AS \"column\", count(value) AS filled, 'double' AS type FROM events UNION ALL SELECT 'user_id', count(user_id), 'bigint' FROM events")
def schema_summary(spark, sf):
    return Q.schema_summary(events(spark, sf).select("value", "user_id"))


@query("align_minute_rank_right", """WITH a AS (SELECT id, soc, t_sec // 60 AS minute, row_number() OVER (PARTITION BY id, t_sec // 60 ORDER BY t_sec, sequence) AS rn FROM tel WHERE gear = 2),
b AS (SELECT id, sequence, tms_mode, t_sec // 60 AS minute, row_number() OVER (PARTITION BY id, t_sec // 60 ORDER BY t_sec, sequence) AS rn FROM tel WHERE tms_mode <> 'Off') SELECT b.id, b.sequence, b.tms_mode, a.soc FROM a RIGHT JOIN b ON a.id = b.id AND a.minute = b.minute AND a.rn = b.rn""")
def align_minute_rank_right(spark, sf):
    df = tel(spark, sf)
    ac = df.where("tms_mode <> 'Off'").select("id", "t_sec", "sequence", F.col("sequence").alias("seq"), "tms_mode")
    return R.align_minute_rank(ac, df.where("gear = 2").select("id", "t_sec", "sequence", "soc")).select("id", F.col("seq").alias("sequence"), "tms_mode", "soc")


@query("join_exact_ts", "SELECT a.sequence AS a, b.sequence AS b FROM tel a JOIN tel b ON a.id = b.id AND a.t_sec = b.t_sec WHERE a.gear = 2 AND b.lat IS NOT NULL")
def join_exact_ts(spark, sf):
    df = tel(spark, sf)
    a, b = df.where("gear = 2").select("id", "t_sec", F.col("sequence").alias("a")), df.where("lat IS NOT NULL").select("id", "t_sec", F.col("sequence").alias("b"))
    return a.join(b, ["id", "t_sec"]).select("a", "b")


@query("semi_filter_ids", "SELECT event_id FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def semi_filter_ids(spark, sf):
    ids = spark.read.parquet(f"{sf}/customer.parquet").where("c_acctbal > 0").select(F.col("c_custkey").alias("user_id"))
    return events(spark, sf).join(ids, "user_id", "left_semi").select("event_id")


@query("id_map_join", "SELECT event_id, n_name FROM events LEFT JOIN nation ON user_id % 40 = n_nationkey")
def id_map_join(spark, sf):
    """Ids without an entry in the map stay, with null."""
    nation = spark.read.parquet(f"{sf}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("k"), "n_name")
    return events(spark, sf).withColumn("k", F.col("user_id") % 40).join(nation, "k", "left").select("event_id", "n_name")


@query("raw_counts_merge", "SELECT id, t_sec // 3600 AS hour, count(*) AS raw, count(CASE WHEN amps IS NOT NULL AND odo IS NOT NULL THEN 1 END) AS usable FROM tel GROUP BY ALL")
def raw_counts_merge(spark, sf):
    return tel(spark, sf).groupBy("id", F.floor(F.col("t_sec") / 3600).alias("hour")).agg(F.count("*").alias("raw"), F.count_if(F.col("amps").isNotNull() & F.col("odo").isNotNull()).alias("usable"))


@query("id_day_presence", "WITH d AS (SELECT DISTINCT user_id, strftime(ts, '%Y-%m-%d') AS day FROM events), u AS (SELECT DISTINCT user_id FROM d), a AS (SELECT DISTINCT day FROM d) SELECT u.user_id, a.day FROM u, a WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.user_id = u.user_id AND d.day = a.day)")
def id_day_presence(spark, sf):
    """Days of the table on which a vehicle has no row: each vehicle's days against the calendar, in one aggregate."""
    d = events(spark, sf).select("user_id", F.to_date("ts").cast("string").alias("day"))
    days = d.agg(F.array_sort(F.collect_set("day")).alias("all"))
    own = d.groupBy("user_id").agg(F.collect_set("day").alias("own"))
    return own.join(F.broadcast(days)).select("user_id", F.explode(F.array_except("all", "own")).alias("day"))


_VALID = """WITH s AS (SELECT *, 2 * 6371000.0 * asin(sqrt(pow(sin((radians(lat) - radians(lag(lat) OVER ({o}))) / 2), 2) + cos(radians(lag(lat) OVER ({o}))) * cos(radians(lat)) * pow(sin(radians(lon - lag(lon) OVER ({o})) / 2), 2))) AS m, greatest(odo - lag(odo) OVER ({o}), 0) * 1000 AS om, odo - lag(odo) OVER ({o}) AS dk FROM tel)
SELECT id, sequence, CASE WHEN dk > 0 AND (m > 5 * om OR m > om + 50) THEN NULL ELSE lat END AS lat FROM s"""


@query("gps_validate", _VALID)
def gps_validate(spark, sf):
    """Fixes that jump much further than the odometer moved are dropped."""
    prev = lambda c: F.lag(c).over(series())
    df = tel(spark, sf)
    df = df.withColumns({"m": haversine_m(prev("lat"), prev("lon"), F.col("lat"), F.col("lon")), "dk": F.col("odo") - prev("odo")})
    om = F.greatest(F.col("dk"), F.lit(0.0)) * 1000
    bad = (F.col("dk") > 0) & ((F.col("m") > 5 * om) | (F.col("m") > om + 50))
    return df.select("id", "sequence", F.when(F.coalesce(bad, F.lit(False)), None).otherwise(F.col("lat")).alias("lat"))


@query("session_number", _METRICS + "SELECT id, session, row_number() OVER (PARTITION BY id ORDER BY start, session) AS number FROM m")
def session_number(spark, sf):
    return sessions._metrics(spark, sf).select("id", "session", F.row_number().over(Window.partitionBy("id").orderBy("start", "session")).alias("number"))


_ALT = f"CASE WHEN {GUN} AND amps < -5 THEN 'CHARGING_ACTIVE' WHEN {GUN} AND amps >= -5 THEN 'CHARGING_IDLE' WHEN NOT {GUN} AND speed > 0.5 AND gear IN (1, 2) THEN 'DISCHARGING_ACTIVE' ELSE 'DISCHARGING_IDLE' END"
_SHARES = ", ".join(f"round(100.0 * count(CASE WHEN {c} = '{label}' THEN 1 END) / nullif(count({c}), 0), 2) AS {name}_{i}" for name, c, labels in (("temp", "tb", X.TEMP_LABELS), ("spread", "db", X.DT_LABELS), ("volt", "vb", X.DV_LABELS)) for i, label in enumerate(labels))


@query("mode_sessions_report", f"WITH b AS (SELECT *, {reports.TB} AS tb, {reports.DB} AS db, {reports.VB} AS vb FROM tel) SELECT id, CAST(g AS bigint) AS session, min(k) AS mode, min(t_sec) AS start, max(t_sec) AS \"end\", round((max(t_sec) - min(t_sec)) / 60, 2) AS minutes, {_SHARES} FROM (" + runs(_ALT, of="b") + ") GROUP BY id, g")
def mode_sessions_report(spark, sf):
    buckets = {"temp": (B.temperature_bucket(), X.TEMP_LABELS), "spread": (B.spread_bucket(), X.DT_LABELS), "volt": (B.millivolt_bucket(), X.DV_LABELS)}
    return E.mode_sessions_report(tel(spark, sf), S.alt_mode(), buckets)


@query("charging_events_simple", "SELECT id, CAST(g AS bigint) AS event, min(t_sec) AS start, max(t_sec) AS \"end\", min(tmax) AS coolest, max(tmax) AS hottest, round(avg(CAST(tmax AS DECIMAL(18,6))), 4) AS mean FROM (" + runs(GUN) + ") WHERE k GROUP BY id, g")
def charging_events_simple(spark, sf):
    df = E.islands(tel(spark, sf), flag("gun"), "event").where(flag("gun"))
    return df.groupBy("id", "event").agg(F.min("t_sec").alias("start"), F.max("t_sec").alias("end"), F.min("tmax").alias("coolest"), F.max("tmax").alias("hottest"), F.round(F.avg(F.col("tmax").cast("decimal(18,6)")).cast("double"), 4).alias("mean"))


@query("fleet_temp_table", _METRICS + ", h AS (SELECT s.id, CAST(g AS bigint) AS session, 100.0 * avg(CASE WHEN tmax > 35 THEN 1 ELSE 0 END) AS p FROM s GROUP BY s.id, g) SELECT m.id, count(*) AS sessions, count(CASE WHEN p > 40 THEN 1 END) AS hot, round(100.0 * count(CASE WHEN p > 40 THEN 1 END) / count(*), 2) AS hot_pct, round(avg(CAST(p AS DECIMAL(18,6))), 2) AS mean_pct FROM m JOIN h ON m.id = h.id AND m.session = h.session GROUP BY m.id")
def fleet_temp_table(spark, sf):
    df = E.mode_gap_sessions(tel(spark, sf).withColumn("mode", S.activity_state()), F.col("mode"))
    one = df.groupBy("id", "session").agg(F.count("*").alias("n"), (100 * F.avg((F.col("tmax") > 35).cast("int"))).alias("p")).where("n >= 2")
    return one.groupBy("id").agg(F.count("*").alias("sessions"), F.count_if(F.col("p") > 40).alias("hot"), F.round(100 * F.count_if(F.col("p") > 40) / F.count("*"), 2).alias("hot_pct"), F.round(F.avg(F.col("p").cast("decimal(18,6)")).cast("double"), 2).alias("mean_pct"))


@query("charging_param_stats", _ENV + ", w AS (SELECT id, envelope, min(s) AS s, max(e) AS e FROM v GROUP BY ALL) SELECT t.id, CAST(w.envelope AS bigint) AS envelope, min(volts) AS volts_min, max(volts) AS volts_max, round(avg(CAST(tmax AS DECIMAL(18,6))), 4) AS tmax_mean FROM tel t JOIN w ON t.id = w.id AND t.t_sec BETWEEN w.s AND w.e GROUP BY ALL")
def charging_param_stats(spark, sf):
    df = tel(spark, sf)
    rows = R.rows_in_intervals(df, E.charging_envelopes(df.withColumn("mode", S.activity_state())))
    return rows.groupBy("id", "envelope").agg(F.min("volts").alias("volts_min"), F.max("volts").alias("volts_max"), F.round(F.avg(F.col("tmax").cast("decimal(18,6)")).cast("double"), 4).alias("tmax_mean"))


_COOL = "coalesce(tms_mode = 'Charging_Cooling', false)"


@query("cooling_sessions", f"WITH c AS (SELECT *, {_COOL} AS k, coalesce(lag({_COOL}) OVER ({{o}}), false) AS b FROM tel) SELECT t_sec // 3600 % 24 AS hour, count(CASE WHEN k AND NOT b THEN 1 END) AS starts, count(CASE WHEN b AND NOT k THEN 1 END) AS stops, round(100.0 * avg(CASE WHEN k THEN 1 ELSE 0 END), 4) AS active_pct FROM c GROUP BY 1")
def cooling_sessions(spark, sf):
    on = F.coalesce(F.col("tms_mode") == "Charging_Cooling", F.lit(False))
    df = tel(spark, sf).withColumn("k", on)
    df = df.withColumn("b", F.coalesce(F.lag("k").over(series()), F.lit(False)))
    return df.groupBy((F.floor(F.col("t_sec") / 3600) % 24).alias("hour")).agg(F.count_if(F.col("k") & ~F.col("b")).alias("starts"), F.count_if(F.col("b") & ~F.col("k")).alias("stops"), F.round(100 * F.avg(F.col("k").cast("int")), 4).alias("active_pct"))


@query("cooling_effectiveness", f"""WITH c AS (SELECT *, tmax - tmin AS d, tmax - lag(tmax) OVER ({{o}}) AS change FROM tel WHERE {_COOL})
SELECT count(d) AS coolant_n, round(avg(CAST(d AS DECIMAL(18,6))), 4) AS coolant_mean, round(stddev_samp(d), 4) AS coolant_std, min(d) AS coolant_min, round(quantile_cont(d, 0.25), 4) AS coolant_25, round(quantile_cont(d, 0.5), 4) AS coolant_50, round(quantile_cont(d, 0.75), 4) AS coolant_75, max(d) AS coolant_max,
 round(100.0 * avg(CASE WHEN tmin <= 28 THEN 1 ELSE 0 END), 4) AS setpoint_pct, round(100.0 * avg(CASE WHEN sequence % 3 = 0 THEN 1 ELSE 0 END), 4) AS compressor_pct, round(avg(CAST(change AS DECIMAL(18,6))), 4) AS mean_change FROM c""")
def cooling_effectiveness(spark, sf):
    """While cooling: the coolant's difference, how often it is at its setpoint, how often the compressor runs, and the change from row to row.

    The view's hottest and coolest cells stand for the coolant going in and out; the compressor runs in every third sample.
    """
    df = tel(spark, sf).where(F.coalesce(F.col("tms_mode") == "Charging_Cooling", F.lit(False)))
    df = df.withColumns({"change": F.col("tmax") - F.lag("tmax").over(series()), "compressor": F.when(F.col("sequence") % 3 == 0, "On").otherwise("Off")})
    share = lambda cond, name: F.round(100 * F.avg(cond.cast("int")), 4).alias(name)
    rates = df.agg(share(F.col("tmin") <= 28, "setpoint_pct"), share(F.col("compressor") == "On", "compressor_pct"), F.round(F.avg(F.col("change").cast("decimal(18,6)")).cast("double"), 4).alias("mean_change"))
    # one row each
    return Q.described(df, [], F.col("tmax") - F.col("tmin"), "coolant").crossJoin(rates)


@query("mode_comparison", f"WITH x AS (SELECT * FROM tel), m AS (SELECT 'charging' AS mode, * FROM x WHERE {GUN} UNION ALL SELECT 'moving', * FROM x WHERE speed > 0 UNION ALL SELECT 'cooling', * FROM x WHERE {_COOL}) SELECT mode, count(*) AS n, round(avg(CAST(tmax AS DECIMAL(18,6))), 4) AS tmax, round(avg(CAST(soc AS DECIMAL(18,6))), 4) AS soc FROM m GROUP BY mode")
def mode_comparison(spark, sf):
    """A row may count for several modes."""
    modes = F.array_compact(F.array(F.when(flag("gun"), "charging"), F.when(F.col("speed") > 0, "moving"), F.when(F.col("tms_mode") == "Charging_Cooling", "cooling")))
    df = tel(spark, sf).select(F.explode(modes).alias("mode"), "tmax", "soc")
    mean = lambda c: F.round(F.avg(F.col(c).cast("decimal(18,6)")).cast("double"), 4).alias(c)
    return df.groupBy("mode").agg(F.count("*").alias("n"), mean("tmax"), mean("soc"))


@query("tms_kpis", "SELECT id, round(avg(CAST(abs(tmax - 30) AS DECIMAL(18,6))), 4) AS mean_error, max(abs(tmax - 30)) AS max_error, round(1 - avg(CASE WHEN tmax = -40 THEN 1 ELSE 0 END), 6) AS reliability FROM tel GROUP BY id")
def tms_kpis(spark, sf):
    err = F.abs(F.col("tmax") - 30)
    return tel(spark, sf).groupBy("id").agg(F.round(F.avg(err.cast("decimal(18,6)")).cast("double"), 4).alias("mean_error"), F.max(err).alias("max_error"), F.round(1 - F.avg((F.col("tmax") == -40).cast("int")), 6).alias("reliability"))


@query("imbalance_by_state", "SELECT CASE WHEN " + GUN + " THEN 'charge' WHEN speed > 0 THEN 'drive' ELSE 'idle' END AS state, count(*) AS n, round(avg(CAST(vmax - vmin AS DECIMAL(18,6))), 6) AS mean, round(quantile_cont(vmax - vmin, 0.95), 6) AS p95 FROM tel GROUP BY 1")
def imbalance_by_state(spark, sf):
    state = F.when(flag("gun"), "charge").when(F.col("speed") > 0, "drive").otherwise("idle")
    x = F.col("vmax") - F.col("vmin")
    df = tel(spark, sf).select(state.alias("state"), x.alias("x"))
    out = df.groupBy("state").agg(F.count("*").alias("n"), F.round(F.avg(F.col("x").cast("decimal(18,6)")).cast("double"), 6).alias("mean"))
    return with_quantiles(out, df, ["state"], F.col("x"), [0.95]).select("state", "n", "mean", F.round(F.get("q", F.lit(0)), 6).alias("p95"))


_DT = "least(coalesce(t_sec - lag(t_sec) OVER ({o}), 0), 300)"


@query("pack_hotspot_share", f"WITH d AS (SELECT (tmax_no - 1) // 9 + 1 AS pack, {_DT} AS dt FROM tel), s AS (SELECT pack, sum(dt) AS x FROM d GROUP BY pack) SELECT pack, round(100.0 * x / sum(x) OVER (), 3) AS pct FROM s")
def pack_hotspot_share(spark, sf):
    df = tel(spark, sf).select(F.expr("(tmax_no - 1) div 9 + 1").alias("pack"), step_seconds(300, "cap").alias("dt"))
    s = df.groupBy("pack").agg(F.sum("dt").alias("x"))
    total = s.agg(F.sum("x").alias("all"))
    return s.join(F.broadcast(total)).select("pack", F.round(100 * F.col("x") / F.col("all"), 3).alias("pct"))


@query("thermal_voltage_hotspots", f"WITH d AS (SELECT *, {_DT} AS dt FROM tel), l AS (SELECT tmax_no AS sensor, dt AS a, 0 AS b FROM d WHERE round((vmax - vmin) * 1000, 3) > 5 UNION ALL SELECT tmin_no, 0, dt FROM d WHERE round((vmax - vmin) * 1000, 3) > 5) SELECT sensor, round(sum(a) / 60.0, 3) AS max_min, round(sum(b) / 60.0, 3) AS min_min FROM l GROUP BY sensor")
def thermal_voltage_hotspots(spark, sf):
    df = tel(spark, sf).withColumn("dt", step_seconds(300, "cap")).where(F.round((F.col("vmax") - F.col("vmin")) * 1000, 3) > 5)
    each = F.explode(F.array(F.struct(F.col("tmax_no").alias("sensor"), F.col("dt").alias("a"), F.lit(0.0).alias("b")), F.struct(F.col("tmin_no").alias("sensor"), F.lit(0.0).alias("a"), F.col("dt").alias("b"))))
    return df.select(each.alias("x")).groupBy("x.sensor").agg(F.round(F.sum("x.a") / 60, 3).alias("max_min"), F.round(F.sum("x.b") / 60, 3).alias("min_min"))


@query("time_weighted_energy", _METRICS + f", a AS (SELECT *, CASE WHEN gun_share > 0.5 THEN 'CHARGING' ELSE 'DISCHARGING' END AS mode FROM m) SELECT id, mode, round(sum(kwh_out * minutes) / nullif(sum(minutes), 0), 4) AS out_kwh, round(sum(kwh_in * minutes) / nullif(sum(minutes), 0), 4) AS in_kwh FROM a GROUP BY id, mode")
def time_weighted_energy(spark, sf):
    m = sessions._metrics(spark, sf).withColumn("mode", F.when(F.col("gun_share") > 0.5, "CHARGING").otherwise("DISCHARGING"))
    mean = lambda c: F.round(F.sum(F.col(c) * F.col("minutes")) / F.nullif(F.sum("minutes"), F.lit(0.0)), 4)
    return m.groupBy("id", "mode").agg(mean("kwh_out").alias("out_kwh"), mean("kwh_in").alias("in_kwh"))


@query("weighted_pct_daily", _METRICS + "SELECT id, start // 86400 AS day, count(*) AS sessions, round(sum(motion_pct * minutes) / nullif(sum(minutes), 0), 3) AS motion_pct, round(sum(gun_pct * minutes) / nullif(sum(minutes), 0), 3) AS gun_pct FROM m GROUP BY ALL")
def weighted_pct_daily(spark, sf):
    m = sessions._metrics(spark, sf)
    mean = lambda c: F.round(F.sum(F.col(c) * F.col("minutes")) / F.nullif(F.sum("minutes"), F.lit(0.0)), 3).alias(c)
    return m.groupBy("id", F.floor(F.col("start") / 86400).alias("day")).agg(F.count("*").alias("sessions"), mean("motion_pct"), mean("gun_pct"))


@query("soc_bucket_alloc", _METRICS + ", a AS (SELECT *, least(soc_start, soc_end) AS lo, greatest(soc_start, soc_end) AS hi FROM m WHERE soc_start <> soc_end), b AS (SELECT a.*, x * 10 AS band, greatest(least(hi, x * 10 + 10) - greatest(lo, x * 10), 0) / (hi - lo) AS part FROM a, range(10) t(x)) SELECT band, round(sum(minutes * part), 2) AS minutes, round(sum(kwh_out * part), 2) AS kwh FROM b WHERE part > 0 GROUP BY band")
def soc_bucket_alloc(spark, sf):
    """Time and energy of sessions dealt to bands of state of charge by the part of the way that lies in each."""
    m = sessions._metrics(spark, sf).where("soc_start <> soc_end").withColumns({"lo": F.least("soc_start", "soc_end"), "hi": F.greatest("soc_start", "soc_end")})
    b = m.withColumn("band", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(90).cast("long"), F.lit(10).cast("long"))))
    part = F.greatest(F.least(F.col("hi"), F.col("band") + 10) - F.greatest(F.col("lo"), F.col("band").cast("double")), F.lit(0.0)) / (F.col("hi") - F.col("lo"))
    b = b.withColumn("part", part).where("part > 0")
    return b.groupBy("band").agg(F.round(F.sum(F.col("minutes") * F.col("part")), 2).alias("minutes"), F.round(F.sum(F.col("kwh_out") * F.col("part")), 2).alias("kwh"))


@query("reaggregate", "WITH q AS (" + reports._mileage(900, 0.01) + ") SELECT period // 86400 AS day, CASE period % 3600 // 900 WHEN 0 THEN 'Q0' WHEN 1 THEN 'Q1' WHEN 2 THEN 'Q2' ELSE 'Q4' END AS quarter, round(sum(CAST(km AS DECIMAL(18,6))), 2) AS km_sum, round(max(km), 3) AS km_max, round(median(kwh_per_km), 3) AS rate_median FROM q GROUP BY ALL")
def reaggregate(spark, sf):
    """Quarter hours summed by day and quarter of the hour."""
    q = reports.mileage_energy_15min(spark, sf)
    quarter = F.element_at(F.array(*map(F.lit, ("Q0", "Q1", "Q2", "Q4"))), (F.floor(F.col("period") % 3600 / 900) + 1).cast("int"))
    return q.groupBy(F.floor(F.col("period") / 86400).alias("day"), quarter.alias("quarter")).agg(F.round(F.sum(F.col("km").cast("decimal(18,6)")), 2).cast("double").alias("km_sum"), F.round(F.max("km"), 3).alias("km_max"), F.round(F.median("kwh_per_km"), 3).alias("rate_median"))


@query("brake_velocity_stats", _STOPS + "SELECT CAST(floor(start_speed / 20) * 20 AS bigint) AS speed, count(*) AS n, median(max_brake) AS pedal_p50, round(quantile_cont(stop - start, 0.95), 4) AS sec_p95 FROM b GROUP BY 1")
def brake_velocity_stats(spark, sf):
    b = E.brake_stops(tel(spark, sf), search_sec=120)
    return b.groupBy((F.floor(F.col("start_speed") / 20) * 20).alias("speed")).agg(F.count("*").alias("n"), F.median("max_brake").alias("pedal_p50"), F.round(F.percentile(F.col("stop") - F.col("start"), 0.95), 4).alias("sec_p95"))


@query("before_after", _STOPS + "SELECT id, count(CASE WHEN start < 1704080000 THEN 1 END) AS n_before, count(CASE WHEN start >= 1704080000 THEN 1 END) AS n_after, round(avg(CASE WHEN start < 1704080000 THEN max_brake END), 4) AS pedal_before, round(avg(CASE WHEN start >= 1704080000 THEN max_brake END), 4) AS pedal_after FROM b GROUP BY id")
def before_after(spark, sf):
    b = E.brake_stops(tel(spark, sf), search_sec=120)
    early = F.col("start") < 1_704_080_000
    return b.groupBy("id").agg(F.count_if(early).alias("n_before"), F.count_if(~early).alias("n_after"), F.round(F.avg(F.when(early, F.col("max_brake"))), 4).alias("pedal_before"), F.round(F.avg(F.when(~early, F.col("max_brake"))), 4).alias("pedal_after"))


FOCUS = list(range(0, 110, 10))


@query("bucket_focus", _STOPS + ", c AS (SELECT id, max_brake // 10 * 10 AS pedal FROM b), t AS (SELECT id, " + ", ".join(f"count(CASE WHEN pedal = {x} THEN 1 END) AS b{x}" for x in FOCUS) + " FROM c GROUP BY id), n AS (SELECT id, pedal, count(*) AS n FROM c GROUP BY ALL), f AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, pedal) AS r FROM n) SELECT f.id, f.pedal, f.n, " + ", ".join(f"b{x}" for x in FOCUS) + " FROM f JOIN t ON f.id = t.id WHERE r = 1")
def bucket_focus(spark, sf):
    """Each vehicle's fullest bucket, and its row of vehicle by bucket."""
    b = E.brake_stops(tel(spark, sf), search_sec=120).withColumn("pedal", F.floor(F.col("max_brake") / 10) * 10)
    by = b.groupBy("id").agg(*(F.count_if(F.col("pedal") == x).alias(f"b{x}") for x in FOCUS))
    top = Q.top_values(b, ["id"], F.col("pedal"), 1).select("id", F.col("value").alias("pedal"), "n")
    return top.join(by, "id")


@query("bucket_vehicle_lists", f"WITH p AS (SELECT id, 100.0 * avg(CASE WHEN tmax > 35 THEN 1 ELSE 0 END) AS hot, 100.0 * avg(CASE WHEN tmax - tmin > 5 THEN 1 ELSE 0 END) AS spread FROM tel GROUP BY id) SELECT id FROM p WHERE hot BETWEEN 35 AND 100 OR spread BETWEEN 45 AND 100")
def bucket_vehicle_lists(spark, sf):
    pct = lambda cond: 100 * F.avg(cond.cast("int"))
    p = tel(spark, sf).groupBy("id").agg(pct(F.col("tmax") > 35).alias("hot"), pct(F.col("tmax") - F.col("tmin") > 5).alias("spread"))
    return p.where(F.col("hot").between(35, 100) | F.col("spread").between(45, 100)).select("id")


@query("low_accuracy_vehicles", f"WITH z AS ({sessions.runs(MODE, 't_sec - pt > 300')}), d AS (SELECT *, least(coalesce(t_sec - lag(t_sec) OVER (PARTITION BY id, g ORDER BY t_sec, sequence), 0), 60) AS dt FROM z), m AS (SELECT id, g, count(*) AS rows, count(CASE WHEN abs(amps) > 10 AND volts IS NOT NULL THEN 1 END) AS act, abs(arg_max_null(soc, row(t_sec, sequence)) - arg_min_null(soc, row(t_sec, sequence))) * avg(soh) * 423 / 1e4 AS soc, abs(CAST(sum(CAST(CASE WHEN abs(amps) > 10 THEN volts * amps * dt / 3.6e6 END AS DECIMAL(18,6))) AS double)) AS kwh FROM d GROUP BY id, g), r AS (SELECT id, round(CASE WHEN soc > 0 THEN (1 - abs(soc - kwh) / soc) * 100 END, 2) AS a FROM m WHERE rows >= 2 AND act > 0) SELECT id, round(avg(CAST(a AS DECIMAL(18,2))), 2) AS accuracy FROM r GROUP BY id HAVING avg(CAST(a AS DECIMAL(18,2))) < 90")
def low_accuracy_vehicles(spark, sf):
    s = E.soc_accuracy_sessions(tel(spark, sf), S.activity_state())
    mean = F.avg(F.col("accuracy_pct").cast("decimal(18,2)"))
    return s.groupBy("id").agg(mean.alias("a")).where("a < 90").select("id", F.round(F.col("a").cast("double"), 2).alias("accuracy"))


@query("daily_temp_avg", """WITH r AS (SELECT t_sec, coalesce(nullif(tmin, 30), nullif(tmax, -40)) AS battery, CASE WHEN vmax_no % 7 <> 0 THEN tmax + 12 END AS motor FROM tel
 WHERE t_sec >= (SELECT max(t_sec) FROM tel) - 30 * 86400 AND ignition = 1 AND speed > 0 AND coalesce(gun, 0) = 0)
SELECT period AS day, round(b, 4) AS battery, round(m, 4) AS motor FROM (SELECT strftime(make_timestamp(t_sec * 1000000), '%Y-%m-%d') AS period, avg(CAST(battery AS DECIMAL(18,6))) AS b, avg(CAST(motor AS DECIMAL(18,6))) AS m FROM r WHERE battery IS NOT NULL AND motor IS NOT NULL GROUP BY 1) ORDER BY battery DESC, day LIMIT 1000""")
def daily_temp_avg(spark, sf):
    """The last 30 days' moving, unplugged samples: battery (coolant first, pack second) and motor by day, hottest first, at most 1000 days."""
    df = tel(spark, sf)
    # the newest sample: one row
    df = df.crossJoin(df.agg(F.max("t_sec").alias("newest"))).where("t_sec >= newest - 30 * 86400 AND ignition = 1 AND speed > 0 AND coalesce(gun, 0) = 0")
    battery, motor = F.coalesce(F.nullif("tmin", F.lit(30.0)), F.nullif("tmax", F.lit(-40.0))), F.when(F.col("vmax_no") % 7 != 0, F.col("tmax") + 12)
    rows = df.select(F.to_date(F.timestamp_seconds("t_sec")).cast("string").alias("day"), battery.alias("battery"), motor.alias("motor")).na.drop()
    mean = lambda c: F.round(F.avg(F.col(c).cast("decimal(18,6)")).cast("double"), 4).alias(c)
    return rows.groupBy("day").agg(mean("battery"), mean("motor")).orderBy(F.desc("battery"), "day").limit(1000)


def _cells(spark, sf):
    """Six cells of each sample, as long rows."""
    cell = F.explode(F.array(*(F.struct(F.lit(i).alias("cell"), (3200 + (F.col("sequence") * (i + 3)) % 50).alias("value")) for i in range(6))))
    return tel(spark, sf).select("id", "sequence", cell.alias("x")).select("id", "sequence", "x.cell", "x.value")


_CELLS = "WITH c AS (SELECT id, sequence, i AS cell, 3200 + sequence * (i + 3) % 50 AS value FROM tel, range(6) t(i)) "


@query("row_cell_stats", _CELLS + "SELECT id, sequence, min(value) AS lo, max(value) AS hi, round(avg(value), 4) AS mean, median(value) AS mid, round(stddev_samp(value), 4) AS sd, round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 4) AS iqr, max(value) - min(value) AS imbalance FROM c GROUP BY ALL")
def row_cell_stats(spark, sf):
    q = F.percentile("value", [0.25, 0.5, 0.75])
    out = _cells(spark, sf).groupBy("id", "sequence").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.round(F.avg("value"), 4).alias("mean"), q.alias("q"), F.round(F.stddev_samp("value"), 4).alias("sd"))
    return out.select("id", "sequence", "lo", "hi", "mean", F.get("q", F.lit(1)).alias("mid"), "sd", F.round(F.get("q", F.lit(2)) - F.get("q", F.lit(0)), 4).alias("iqr"), (F.col("hi") - F.col("lo")).alias("imbalance"))


@query("extreme_hits", _CELLS + ", e AS (SELECT *, min(value) OVER (PARTITION BY id, sequence) AS lo, max(value) OVER (PARTITION BY id, sequence) AS hi FROM c) SELECT cell, count(CASE WHEN value = lo THEN 1 END) AS lowest, count(CASE WHEN value = hi THEN 1 END) AS highest FROM e GROUP BY cell")
def extreme_hits(spark, sf):
    w = Window.partitionBy("id", "sequence")
    e = _cells(spark, sf).withColumns({"lo": F.min("value").over(w), "hi": F.max("value").over(w)})
    return e.groupBy("cell").agg(F.count_if(F.col("value") == F.col("lo")).alias("lowest"), F.count_if(F.col("value") == F.col("hi")).alias("highest"))


@query("coverage_bus_corr", "WITH v AS (SELECT CAST((amps IS NOT NULL) AS int) + CAST((odo IS NOT NULL) AS int) + CAST((lat IS NOT NULL) AS int) AS n, soc, tmax FROM tel) SELECT round(corr(n, soc), 6) AS soc, round(corr(n, tmax), 6) AS tmax FROM v")
def coverage_bus_corr(spark, sf):
    n = sum((F.col(c).isNotNull().cast("int") for c in ("odo", "lat")), F.col("amps").isNotNull().cast("int"))
    return tel(spark, sf).select(n.cast("double").alias("n"), "soc", "tmax").agg(F.round(F.corr("n", "soc"), 6).alias("soc"), F.round(F.corr("n", "tmax"), 6).alias("tmax"))


@query("dbc_id_map", "SELECT sequence, (sequence + 2147483648) & 2147483647 AS raw FROM tel")
def dbc_id_map(spark, sf):
    return tel(spark, sf).select("sequence", W.raw_id(F.col("sequence") + 2147483648).alias("raw"))


@query("any_contactor", f"SELECT id, sequence, {GUN} AND greatest(coalesce(brake, 0), coalesce(gear, 0)) <> 0 AS closed FROM tel")
def any_contactor(spark, sf):
    """Any of several contactors while plugged; the view's brake and gear stand for them."""
    any_on = F.greatest(F.coalesce("brake", F.lit(0)), F.coalesce("gear", F.lit(0)).cast("long")) != 0
    return tel(spark, sf).select("id", "sequence", (flag("gun") & any_on).alias("closed"))


_IDS = "CASE WHEN amps IS NULL THEN 0 ELSE 1 END + CASE WHEN odo IS NULL THEN 0 ELSE 1 END + CASE WHEN lat IS NULL THEN 0 ELSE 1 END"


@query("gap_diagnosis", f"""WITH g AS (SELECT id, sequence AS gap, lag(t_sec) OVER ({{o}}) AS start, t_sec AS "end" FROM tel), h AS (SELECT * FROM g WHERE "end" - start > 500),
x AS (SELECT h.id, gap, ready, gun, CASE WHEN odo IS NULL THEN 1 ELSE 0 END + CASE WHEN amps IS NULL THEN 1 ELSE 0 END + CASE WHEN lat IS NULL THEN 1 ELSE 0 END AS missing, {_IDS} AS ids FROM h JOIN tel t ON t.id = h.id AND t.t_sec BETWEEN h.start AND h."end"),
a AS (SELECT id, gap, count(*) AS rows, round(100 * avg(missing / 3), 2) AS null_pct, round(avg(CAST(ids AS DECIMAL(18,6))), 4) AS mean_ids FROM x GROUP BY id, gap),
r AS (SELECT id, gap, ready AS v FROM x WHERE ready IS NOT NULL GROUP BY id, gap, ready QUALIFY row_number() OVER (PARTITION BY id, gap ORDER BY count(*) DESC, ready) = 1),
u AS (SELECT id, gap, gun AS v FROM x WHERE gun IS NOT NULL GROUP BY id, gap, gun QUALIFY row_number() OVER (PARTITION BY id, gap ORDER BY count(*) DESC, gun) = 1)
SELECT a.id, a.gap, rows, null_pct, mean_ids, r.v AS ready_mode, u.v AS gun_mode FROM a LEFT JOIN r ON r.id = a.id AND r.gap = a.gap LEFT JOIN u ON u.id = a.id AND u.gap = a.gap""")
def gap_diagnosis(spark, sf):
    """Gaps above 500 seconds: missing values, bus ids and flags of the samples at their ends. Signals that are there stand for ids."""
    df = tel(spark, sf).withColumn("ids", F.expr(_IDS))
    gaps = df.select("id", F.col("sequence").alias("gap"), F.lag("t_sec").over(series()).alias("start"), F.col("t_sec").alias("end")).where(F.col("end") - F.col("start") > 500)
    return Q.gap_diagnosis(df, gaps, ["odo", "amps", "lat"], "ids", ["ready", "gun"])
