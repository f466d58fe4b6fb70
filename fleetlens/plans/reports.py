"""Queries: distributions, mileage, profiles, reconciliation, set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from fleetlens.functions import expressions as X
from fleetlens.functions.expressions import flag
from fleetlens.operators import buckets as B
from fleetlens.operators import quality as Q
from fleetlens.operators import sessions as E
from fleetlens.operators import states as S
from fleetlens.operators.quantiles import with_quantiles
from fleetlens.operators.timeseries import series, step_seconds
from fleetlens.plans import sequences
from fleetlens.plans.registry import query
from fleetlens.plans.sequences import SENSOR_CYCLES
from fleetlens.plans.series import GUN
from fleetlens.plans.sessions import _SESS, _STOPS
from fleetlens.sources.telemetry import telemetry as tel

CM = f"CASE WHEN {GUN} THEN 'CHARGING' ELSE 'DISCHARGING' END"


def cases(x: str, edges: list, labels: list, low: str = "") -> str:
    return f"CASE {low} " + " ".join(f"WHEN {x} <= {e} THEN '{n}'" for e, n in zip(edges, labels)) + f" WHEN {x} IS NOT NULL THEN '{labels[len(edges)]}' END"


TB = cases("tmax", X.TEMP_EDGES, X.TEMP_LABELS)
DB = cases("(tmax - tmin)", X.DT_EDGES, X.DT_LABELS)
VB = cases("round((vmax - vmin) * 1000, 3)", X.DV_EDGES, X.DV_LABELS, "WHEN round((vmax - vmin) * 1000, 3) < 0 THEN NULL")
SB = cases("soc", X.SOC_EDGES, X.SOC_LABELS, "WHEN soc <= 0 THEN NULL")


def pcts(labels: list) -> str:
    return ", ".join(f"round(100.0 * count(CASE WHEN b = '{n}' THEN 1 END) / nullif(count(b), 0), 2) AS pct_{i}" for i, n in enumerate(labels))


@query("bucketize", f"SELECT id, sequence, {TB} AS t, {DB} AS d, {VB} AS v, {SB} AS s FROM tel")
def bucketize(spark, sf):
    return tel(spark, sf).select("id", "sequence", B.temperature_bucket().alias("t"), B.spread_bucket().alias("d"), B.millivolt_bucket().alias("v"), B.soc_bucket().alias("s"))


@query("session_bucket_pct", f"WITH s AS ({_SESS}) SELECT id, CAST(g AS bigint) AS session, {pcts(X.TEMP_LABELS)} FROM (SELECT *, {TB} AS b FROM s) GROUP BY id, g")
def session_bucket_pct(spark, sf):
    df = E.mode_gap_sessions(tel(spark, sf).withColumn("mode", S.activity_state()), F.col("mode"))
    return B.share_of_rows(df, ["id", "session"], B.temperature_bucket(), X.TEMP_LABELS)


_MB = f"SELECT id, mode, {pcts(X.TEMP_LABELS)} FROM (SELECT *, {TB} AS b, {CM} AS mode FROM tel) GROUP BY id, mode"


@query("mode_bucket_pct", _MB + " -- tel")
def mode_bucket_pct(spark, sf):
    return B.share_of_rows(tel(spark, sf).withColumn("mode", S.charge_mode()), ["id", "mode"], B.temperature_bucket(), X.TEMP_LABELS)


@query("fleet_bucket_mean", f"WITH m AS ({_MB}), s AS (SELECT mode, " + ", ".join(f"sum(CAST(pct_{i} AS DECIMAL(18,2))) AS pct_{i}" for i in range(5)) + " FROM m GROUP BY mode) SELECT mode, " + ", ".join(f"round(100 * CAST(pct_{i} AS double) / CAST(pct_0 + pct_1 + pct_2 + pct_3 + pct_4 AS double), 2) AS pct_{i}" for i in range(5)) + " FROM s")
def fleet_bucket_mean(spark, sf):
    return B.fleet_mean(mode_bucket_pct(spark, sf), ["mode"], X.TEMP_LABELS)


@query("condition_buckets", f"WITH p AS (SELECT id, 100.0 * avg(CASE WHEN tmax > 35 THEN 1 ELSE 0 END) AS p FROM tel WHERE {GUN} GROUP BY id) SELECT CASE WHEN p < 20 THEN '<20' WHEN p < 30 THEN '20-30' WHEN p < 40 THEN '30-40' ELSE '>=40' END AS label, count(*) AS vehicles, string_agg(id, ',' ORDER BY id) AS ids FROM p GROUP BY 1")
def condition_buckets(spark, sf):
    p = tel(spark, sf).where(flag("gun")).groupBy("id").agg((100 * F.avg((F.col("tmax") > 35).cast("int"))).alias("p"))
    label = F.when(F.col("p") < 20, "<20").when(F.col("p") < 30, "20-30").when(F.col("p") < 40, "30-40").otherwise(">=40")
    return p.groupBy(label.alias("label")).agg(F.count("*").alias("vehicles"), F.array_join(F.array_sort(F.collect_list("id")), ",").alias("ids"))


@query("soc_occupancy", f"WITH d AS (SELECT *, least(coalesce(t_sec - lag(t_sec) OVER ({{o}}), 0), 300) AS dt, {CM} AS mode, {SB} AS bucket FROM tel), s AS (SELECT mode, bucket, sum(dt) AS x FROM d WHERE bucket IS NOT NULL GROUP BY ALL) SELECT mode, bucket, round(100.0 * x / nullif(sum(x) OVER (PARTITION BY mode), 0), 2) AS pct FROM s")
def soc_occupancy(spark, sf):
    return B.share_of_time(tel(spark, sf).withColumn("mode", S.charge_mode()), ["mode"], B.soc_bucket())


@query("soc_jump_distribution", f"WITH d AS (SELECT {CM} AS mode, (soc - lag(soc) OVER ({{o}})) / nullif(t_sec - lag(t_sec) OVER ({{o}}), 0) * 60 AS r FROM tel) SELECT mode, CASE WHEN r <= -1 THEN 'fall' WHEN r <= 1 THEN 'flat' ELSE 'rise' END AS bin, count(*) AS n FROM d WHERE r IS NOT NULL GROUP BY ALL")
def soc_jump_distribution(spark, sf):
    dt = F.col("t_sec") - F.lag("t_sec").over(series())
    df = tel(spark, sf).select(S.charge_mode().alias("mode"), ((F.col("soc") - F.lag("soc").over(series())) / F.nullif(dt, F.lit(0)) * 60).alias("r")).where("r IS NOT NULL")
    return df.groupBy("mode", X.bucket(F.col("r"), [-1, 1], ["fall", "flat", "rise"]).alias("bin")).agg(F.count("*").alias("n"))


@query("c_rate_stats", f"WITH c AS (SELECT id, {CM} AS mode, least(greatest(amps / 423.8, -3), 3) AS c FROM tel WHERE amps IS NOT NULL) SELECT id, mode, round(avg(CAST(c AS DECIMAL(18,6))), 4) AS mean_c, round(median(c), 4) AS median_c, round(max(c), 4) AS max_c FROM c GROUP BY id, mode")
def c_rate_stats(spark, sf):
    df = tel(spark, sf).where("amps IS NOT NULL").select("id", S.charge_mode().alias("mode"), F.least(F.greatest(F.col("amps") / 423.8, F.lit(-3.0)), F.lit(3.0)).alias("c"))
    return df.groupBy("id", "mode").agg(F.round(F.avg(F.col("c").cast("decimal(18,6)")).cast("double"), 4).alias("mean_c"), F.round(F.median("c"), 4).alias("median_c"), F.round(F.max("c"), 4).alias("max_c"))


def _hot(key: str, n: str = "1") -> str:
    return f"WITH x AS (SELECT *, {CM} AS mode, {n} AS w FROM tel), l AS (SELECT mode, 'max' AS kind, {key.format('tmax_no')} AS sensor, w FROM x UNION ALL SELECT mode, 'min', {key.format('tmin_no')}, w FROM x), s AS (SELECT mode, kind, sensor, sum(w) AS n FROM l GROUP BY ALL) SELECT mode, kind, sensor, CAST(n AS bigint) AS n, round(100.0 * n / nullif(sum(n) OVER (PARTITION BY mode, kind), 0), 2) AS pct FROM s"


KINDS = {"max": "tmax_no", "min": "tmin_no"}


@query("hotspot_counts", _hot("{}"))
def hotspot_counts(spark, sf):
    return B.hotspots(tel(spark, sf).withColumn("mode", S.charge_mode()), ["mode"], KINDS)


@query("pack_hotspots", _hot("(({} - 1) // 9 + 1)"))
def pack_hotspots(spark, sf):
    df = tel(spark, sf).withColumn("mode", S.charge_mode())
    return B.hotspots(df.withColumns({c: F.expr(f"({c} - 1) div 9 + 1") for c in KINDS.values()}), ["mode"], KINDS)


@query("hotspot_durations", _hot("{}", "least(coalesce(t_sec - lag(t_sec) OVER ({o}), 0), 300)"))
def hotspot_durations(spark, sf):
    return B.hotspots(tel(spark, sf).withColumn("mode", S.charge_mode()), ["mode"], KINDS, F.least(F.coalesce(F.col("t_sec") - F.lag("t_sec").over(series()), F.lit(0)), F.lit(300)))


@query("outer_join_minmax", "SELECT coalesce(a.s, b.s) AS sensor, coalesce(a.n, 0) AS max_n, coalesce(b.n, 0) AS min_n FROM (SELECT tmax_no AS s, count(*) AS n FROM tel GROUP BY 1) a FULL JOIN (SELECT tmin_no AS s, count(*) AS n FROM tel GROUP BY 1) b ON a.s = b.s")
def outer_join_minmax(spark, sf):
    return B.extremes_side_by_side(tel(spark, sf), "tmax_no", "tmin_no")


@query("high_dv_by_soc", f"SELECT {SB} AS band, round(median((vmax - vmin) * 1000), 4) AS dv_median, round(quantile_cont((vmax - vmin) * 1000, 0.95), 4) AS dv_p95, median(abs(amps)) AS amps_median, max(abs(amps)) AS amps_max, count(DISTINCT id) AS vehicles FROM tel WHERE {GUN} AND (vmax - vmin) * 1000 > 20 AND soc > 0 GROUP BY 1")
def high_dv_by_soc(spark, sf):
    dv = (F.col("vmax") - F.col("vmin")) * 1000
    df = tel(spark, sf).where(flag("gun") & (dv > 20) & (F.col("soc") > 0))
    df = df.select("id", B.soc_bucket().alias("band"), dv.alias("dv"), F.abs("amps").alias("amps"))
    out = df.groupBy("band").agg(F.max("amps").alias("amps_max"), F.count_distinct("id").alias("vehicles"))
    out = with_quantiles(with_quantiles(out, df, ["band"], F.col("dv"), [0.5, 0.95]), df, ["band"], F.col("amps"), [0.5], "a")
    return out.select("band", F.round(F.get("q", F.lit(0)), 4).alias("dv_median"), F.round(F.get("q", F.lit(1)), 4).alias("dv_p95"), F.get("a", F.lit(0)).alias("amps_median"), "amps_max", "vehicles")


def _mileage(sec: int, least: float) -> str:
    return f"""WITH d AS (SELECT *, CASE WHEN t_sec - lag(t_sec) OVER ({{o}}) <= 300 THEN t_sec - lag(t_sec) OVER ({{o}}) ELSE 0 END AS dt, greatest(odo - lag(odo) OVER ({{o}}), CASE WHEN odo - lag(odo) OVER ({{o}}) IS NULL THEN NULL ELSE 0 END) AS dk0, speed - lag(speed) OVER ({{o}}) AS dv FROM tel),
e AS (SELECT *, coalesce(dk0, 0) AS dk, volts * amps / 1000 * dt / 3600 AS kwh FROM d),
s AS (SELECT id, t_sec // {sec} * {sec} AS period, CAST(sum(CAST(dk AS DECIMAL(18,6))) AS double) AS km, coalesce(CAST(sum(CASE WHEN kwh > 0 AND speed > 0 THEN CAST(kwh AS DECIMAL(18,6)) END) AS double), 0) AS used, 0.8 * coalesce(CAST(sum(CASE WHEN kwh < 0 AND dv < 0 THEN CAST(-kwh AS DECIMAL(18,6)) END) AS double), 0) AS regen,
 coalesce(CAST(sum(CASE WHEN kwh > 0 AND speed = 0 THEN CAST(kwh AS DECIMAL(18,6)) END) AS double), 0) AS idle, count(*) AS n, count(CASE WHEN amps IS NOT NULL AND odo IS NOT NULL THEN 1 END) AS u FROM e GROUP BY ALL)
SELECT id, period, round(km, 3) AS km, round(used, 3) AS used_kwh, round(regen, 3) AS regen_kwh, round(idle, 3) AS idle_kwh, round(used - regen, 3) AS net_kwh, round(CASE WHEN km >= {least} THEN (used - regen) / km END, 3) AS kwh_per_km, round(100.0 * n / {sec}, 3) AS rows_pct, round(100.0 * u / {sec}, 3) AS usable_pct FROM s"""


@query("mileage_energy_hourly", _mileage(3600, 0.1))
def mileage_energy_hourly(spark, sf):
    return B.mileage_energy(tel(spark, sf), 3600)


@query("mileage_energy_15min", _mileage(900, 0.01))
def mileage_energy_15min(spark, sf):
    return B.mileage_energy(tel(spark, sf), 900, 0.01)


@query("mileage_energy_daily", _mileage(86400, 0.1))
def mileage_energy_daily(spark, sf):
    return B.mileage_energy(tel(spark, sf), 86_400)


@query("daily_counts", "SELECT user_id, strftime(ts + INTERVAL 330 MINUTE, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY ALL")
def daily_counts(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").select("user_id", "ts")
    return e.groupBy("user_id", F.to_date(F.col("ts") + F.expr("INTERVAL 330 MINUTES")).cast("string").alias("day")).agg(F.count("*").alias("n"))


_PREV = "(SELECT event_type AS cur, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events)"


def _events_prev(spark, sf):
    from pyspark.sql import Window

    e = spark.read.parquet(f"{sf}/events.parquet").select("user_id", "event_id", "ts", "event_type")
    return e.select("ts", F.col("event_type").alias("cur"), F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("prev")).where("prev IS NOT NULL")


@query("transition_counts", """WITH p AS (SELECT event_type AS cur, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev, hour(ts) AS h FROM events),
c AS (SELECT prev, cur, h, count(*) AS k FROM p WHERE prev IS NOT NULL GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY prev, cur ORDER BY k DESC, h) AS place FROM c)
SELECT prev, cur, CAST(sum(k) AS bigint) AS n, string_agg(h || ':' || k, ',' ORDER BY h) AS by_hour, string_agg(CASE WHEN place <= 3 THEN CAST(h AS varchar) END, ',' ORDER BY place) AS top_hours FROM r GROUP BY prev, cur""")
def transition_counts(spark, sf):
    """Changes of state, when in the day they happen, and the three hours in which most do."""
    w = Window.partitionBy("prev", "cur").orderBy(F.desc("k"), "h")
    by = _events_prev(spark, sf).groupBy("prev", "cur", F.hour("ts").alias("h")).agg(F.count("*").alias("k")).withColumn("place", F.row_number().over(w))
    listed = lambda x: F.array_join(F.transform(F.array_sort(F.collect_list(x)), lambda y: y["text"]), ",")
    hours = listed(F.struct("h", F.concat_ws(":", "h", "k").alias("text")))
    top = listed(F.when(F.col("place") <= 3, F.struct("place", F.col("h").cast("string").alias("text"))))
    return by.groupBy("prev", "cur").agg(F.sum("k").alias("n"), hours.alias("by_hour"), top.alias("top_hours"))


TYPES = ["click", "error", "purchase", "signup", "view"]


@query("transition_crosstab", "SELECT prev, " + ", ".join(f"count(CASE WHEN cur = '{t}' THEN 1 END) AS \"{t}\"" for t in TYPES) + f" FROM {_PREV} WHERE prev IS NOT NULL GROUP BY prev")
def transition_crosstab(spark, sf):
    return _events_prev(spark, sf).groupBy("prev").pivot("cur", TYPES).count().na.fill(0)


@query("value_distribution", "SELECT event_type, count(*) AS n, round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY event_type")
def value_distribution(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    out = with_quantiles(e.groupBy("event_type").agg(F.count("*").alias("n")), e, ["event_type"], F.col("value"), [0.25, 0.5, 0.95])
    return out.select("event_type", "n", *(F.round(F.get("q", F.lit(i)), 6).alias(c) for i, c in enumerate(("p25", "p50", "p95"))))


@query("distinct_count", "SELECT count(DISTINCT id) AS vehicles, count(DISTINCT tmax_no) AS sensors, count(DISTINCT tms_mode) AS modes FROM tel")
def distinct_count(spark, sf):
    return tel(spark, sf).agg(F.count_distinct("id").alias("vehicles"), F.count_distinct("tmax_no").alias("sensors"), F.count_distinct("tms_mode").alias("modes"))


COLS = ["amps", "volts", "soc", "tmax", "tmin", "speed", "odo"]


@query("correlation_matrix", "WITH x AS (SELECT * FROM tel), c AS (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM x" for i, a in enumerate(COLS) for b in COLS[i + 1 :]) + ") SELECT a, b, r, coalesce(abs(r) > 0.5 AND abs(r) < 1, false) AS strong FROM c")
def correlation_matrix(spark, sf):
    """strong: the pairs that a report names."""
    r = F.abs(F.col("r"))
    return Q.correlations(tel(spark, sf), COLS).withColumn("strong", F.coalesce((r > 0.5) & (r < 1), F.lit(False)))


#: Student's t quantiles of a two-sided 99.5 % interval for 1 to 40 degrees of freedom: fixed values, for the SQL alone.
T995 = """
127.3213364689, 14.0890472756, 7.4533185052, 5.5975683671, 4.7733406049, 4.3168271036, 4.0293371776, 3.8325186853, 3.6896623923, 3.5814062021,
3.4966141733, 3.4284442423, 3.3724679410, 3.3256958178, 3.2860385709, 3.2519928744, 3.2224499114, 3.1965742223, 3.1737245308, 3.1534005329,
3.1352062454, 3.1188242069, 3.1039969631, 3.0905135487, 3.0781994605, 3.0669091164, 3.0565201089, 3.0469287751, 3.0380467448, 3.0297982236,
3.0221178343, 3.0149488884, 3.0082419901, 3.0019539015, 2.9960466119, 2.9904865724, 2.9852440597, 2.9802926467, 2.9756087578, 2.9711712949"""
#: Beyond 40 degrees: the normal quantile and what the first powers of 1 / df add to it.
_BEYOND = "2.807033768343804 + 6.23122098212844 / v + 12.850915758205604 / v ** 2 + 20.220685853121086 / v ** 3 + 23.150431330724107 / v ** 4"


@query("mean_ci", SENSOR_CYCLES + f""", q AS (SELECT unnest(range(1, 41)) AS v, unnest([{T995.strip()}]) AS t), g AS (SELECT id, count(*) AS n, avg(CAST("end" - start AS DECIMAL(18,6))) AS m, stddev_samp("end" - start) AS s FROM cy GROUP BY ROLLUP (id)),
h AS (SELECT *, CAST(n - 1 AS double) AS v FROM g)
SELECT coalesce(id, 'ALL') AS id, n, round(m, 6) AS mean, round(CASE WHEN h.v >= 1 THEN coalesce(q.t, __BEYOND__) END * s / sqrt(n), 3) AS half FROM h LEFT JOIN q ON q.v = h.v""".replace("__BEYOND__", _BEYOND.replace("/ v", "/ h.v")))
def mean_ci(spark, sf):
    """Lengths of sweep cycles: an interval for each vehicle and one over all."""
    cycles = sequences.sweep_cycles(spark, sf)
    return Q.mean_interval(cycles, ["id"], F.col("end") - F.col("start")).na.fill("ALL", ["id"])


@query("threshold_compliance", f"SELECT {CM} AS mode, round(100.0 * avg(CASE WHEN tmax > CASE WHEN {GUN} THEN 30 ELSE 35 END THEN 1 ELSE 0 END), 4) AS over_pct, median(tmax) AS median_t FROM tel WHERE tms_mode <> 'Off' GROUP BY 1")
def threshold_compliance(spark, sf):
    df = tel(spark, sf).where("tms_mode <> 'Off'")
    over = F.col("tmax") > F.when(flag("gun"), 30).otherwise(35)
    return df.groupBy(S.charge_mode().alias("mode")).agg(F.round(100 * F.avg(over.cast("int")), 4).alias("over_pct"), F.median("tmax").alias("median_t"))


@query("time_in_band", "WITH d AS (SELECT *, least(coalesce(t_sec - lag(t_sec) OVER ({o}), 0), 300) AS dt, tmax - tmin AS x FROM tel) SELECT id, round(100.0 * sum(CASE WHEN x < 5 THEN dt ELSE 0 END) / sum(dt), 2) AS below, round(100.0 * sum(CASE WHEN x BETWEEN 5 AND 8 THEN dt ELSE 0 END) / sum(dt), 2) AS inside, round(100.0 * sum(CASE WHEN x > 8 THEN dt ELSE 0 END) / sum(dt), 2) AS above FROM d GROUP BY id")
def time_in_band(spark, sf):
    df = tel(spark, sf).withColumns({"dt": step_seconds(300, "cap"), "x": F.col("tmax") - F.col("tmin")})
    pct = lambda cond: F.round(100 * F.sum(F.when(cond, F.col("dt")).otherwise(0)) / F.sum("dt"), 2)
    return df.groupBy("id").agg(pct(F.col("x") < 5).alias("below"), pct(F.col("x").between(5, 8)).alias("inside"), pct(F.col("x") > 8).alias("above"))


@query("bpp_buckets", _STOPS + """, c AS (SELECT max_brake // 5 * 5 AS pedal, count(*) AS n FROM b GROUP BY 1), e AS (SELECT unnest(range(0, CAST(max(pedal) AS bigint) + 5, 5)) AS pedal FROM c)
SELECT CAST(e.pedal AS bigint) AS pedal, coalesce(n, 0) AS n, e.pedal = (SELECT arg_max(pedal, (n, -pedal)) FROM c) AS is_mode, (SELECT mode(max_brake ORDER BY max_brake) FROM b) AS mode_value FROM e LEFT JOIN c ON e.pedal = c.pedal""")
def bpp_buckets(spark, sf):
    """Buckets of five up to the hardest braking, empty ones too; the fullest one, and the most frequent value."""
    b = E.brake_stops(tel(spark, sf), search_sec=120)
    n = b.groupBy((F.floor(F.col("max_brake") / 5) * 5).alias("pedal")).agg(F.count("*").alias("n"))
    # one row: the pedal goes to 100
    all_of = n.agg(F.max("pedal").alias("most"), F.max_by("pedal", F.struct("n", -F.col("pedal"))).alias("fullest"))
    value = b.agg(F.mode("max_brake", True).alias("mode_value"))
    each = all_of.where("most IS NOT NULL").crossJoin(F.broadcast(value)).select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("most"), F.lit(5).cast("long"))).alias("pedal"), "fullest", "mode_value")
    return each.join(n, "pedal", "left").select("pedal", F.coalesce("n", F.lit(0)).alias("n"), (F.col("pedal") == F.col("fullest")).alias("is_mode"), "mode_value")


@query("brake_bucket_stats", _STOPS + 'SELECT max_brake // 10 * 10 AS pedal, median(start_speed) AS speed_p50, round(quantile_cont(start_speed, 0.95), 4) AS speed_p95, round(median(stop - start), 4) AS sec_p50 FROM b GROUP BY 1')
def brake_bucket_stats(spark, sf):
    b = E.brake_stops(tel(spark, sf), search_sec=120)
    return b.groupBy((F.floor(F.col("max_brake") / 10) * 10).alias("pedal")).agg(F.median("start_speed").alias("speed_p50"), F.round(F.percentile("start_speed", 0.95), 4).alias("speed_p95"), F.round(F.median(F.col("stop") - F.col("start")), 4).alias("sec_p50"))


NUM = ["amps", "volts", "soc", "odo", "tmax"]


def union(parts: list[str]) -> str:
    return " UNION ALL ".join(parts)


@query("profile_numeric", "WITH x AS (SELECT * FROM tel) " + union([f"SELECT '{c}' AS \"column\", round(100.0 * count({c}) / count(*), 2) AS filled_pct, min({c}) AS least, " + ", ".join(f"round(quantile_cont({c}, {p}), 6) AS p{int(100 * p):02d}" for p in Q.QUANTILES) + f", max({c}) AS most FROM x" for c in NUM]))
def profile_numeric(spark, sf):
    return Q.profile_numeric(tel(spark, sf), NUM)


@query("profile_categoricals", """WITH c AS (SELECT event_type AS v, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, event_type) AS rk FROM events GROUP BY 1)
SELECT 'event_type' AS "column", 100.0 AS filled_pct, count(*) AS "distinct", 0 AS junk, string_agg(CASE WHEN rk <= 3 THEN v || ':' || n END, ', ' ORDER BY rk) AS top FROM c""")
def profile_categoricals(spark, sf):
    return Q.profile_categoricals(spark.read.parquet(f"{sf}/events.parquet"), ["event_type"])


@query("gap_profile", "WITH x AS (SELECT * FROM tel) " + union([f"SELECT '{c}' AS \"column\", count(*) AS n, round(avg(d), 4) AS mean, round(stddev_samp(d), 4) AS std, min(d) AS least, max(d) AS most, round(median(d), 4) AS p50, round(quantile_cont(d, 0.95), 4) AS p95 FROM (SELECT CAST(t_sec - lag(t_sec) OVER ({{o}}) AS double) AS d FROM x WHERE {c} IS NOT NULL) WHERE d IS NOT NULL" for c in ("amps", "odo")]))
def gap_profile(spark, sf):
    return Q.gap_profile(tel(spark, sf), ["amps", "odo"])


@query("missing_rates", "WITH x AS (SELECT * FROM tel) " + union([f"SELECT '{c}' AS \"column\", round(100.0 * avg(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END), 4) AS null_pct FROM x" for c in ("gun", "amps", "odo", "lat", "soc")]))
def missing_rates(spark, sf):
    return Q.missing_rates(tel(spark, sf), ["gun", "amps", "odo", "lat", "soc"])


@query("null_share_report", "WITH x AS (SELECT * FROM tel) SELECT * FROM (" + union([f"SELECT '{c}' AS \"column\", round(100.0 * avg(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END), 4) AS null_pct FROM x" for c in ("gun", "amps", "odo", "lat", "soc")]) + ") WHERE null_pct > 15")
def null_share_report(spark, sf):
    return missing_rates(spark, sf).where("null_pct > 15")


@query("source_span", "WITH x AS (SELECT * FROM tel) SELECT 'can' AS source, min(t_sec) AS first, max(t_sec) AS last, count(*) AS rows FROM x UNION ALL SELECT 'gps', min(t_sec), max(t_sec), count(*) FROM x WHERE lat IS NOT NULL")
def source_span(spark, sf):
    df = tel(spark, sf)
    return Q.source_spans({"can": df, "gps": df.where("lat IS NOT NULL")})


def _copies(spark, sf):
    """The feed, and a copy that lacks some rows and differs in some."""
    df = tel(spark, sf).select("id", "sequence", "soc", "volts", "odo")
    a = df.where("sequence % 17 <> 0")
    b = df.where("sequence % 19 <> 0").withColumn("soc", F.when(F.col("sequence") % 23 == 0, F.col("soc") + 1).otherwise(F.col("soc"))).withColumn("odo", F.when(F.col("sequence") % 29 != 0, F.col("odo")))
    return Q.paired(a, b, ["id", "sequence"])


_CP = "WITH a AS (SELECT * FROM tel WHERE sequence % 17 <> 0), b AS (SELECT id, sequence, CASE WHEN sequence % 23 = 0 THEN soc + 1 ELSE soc END AS soc, volts, CASE WHEN sequence % 29 <> 0 THEN odo END AS odo FROM tel WHERE sequence % 19 <> 0), j AS (SELECT a.soc AS s0, b.soc AS s1, a.volts AS v0, b.volts AS v1, a.odo AS o0, b.odo AS o1, a.id AS i0, b.id AS i1, coalesce(a.id, b.id) AS id, coalesce(a.sequence, b.sequence) AS sequence FROM a FULL JOIN b ON a.id = b.id AND a.sequence = b.sequence) "


@query("full_outer_reconcile", _CP + "SELECT count(CASE WHEN i0 IS NULL THEN 1 END) AS missing_left, count(CASE WHEN i1 IS NULL THEN 1 END) AS missing_right, count(CASE WHEN i0 = i1 THEN 1 END) AS matched FROM j")
def full_outer_reconcile(spark, sf):
    return _copies(spark, sf).agg(F.count_if(F.col("has_l").isNull()).alias("missing_left"), F.count_if(F.col("has_r").isNull()).alias("missing_right"), F.count_if(F.col("has_l") & F.col("has_r")).alias("matched"))


@query("reconcile_mismatch_counts", _CP + union([f"SELECT '{c}' AS \"column\", count(CASE WHEN {x}0 IS DISTINCT FROM {x}1 THEN 1 END) AS differing FROM j WHERE i0 = i1" for c, x in (("soc", "s"), ("volts", "v"), ("odo", "o"))]))
def reconcile_mismatch_counts(spark, sf):
    return Q.mismatch_counts(_copies(spark, sf), ["soc", "volts", "odo"])


@query("reconcile_row_diffs", _CP + "SELECT id, sequence, (CASE WHEN s0 IS DISTINCT FROM s1 THEN 1 ELSE 0 END) + (CASE WHEN o0 IS DISTINCT FROM o1 THEN 1 ELSE 0 END) AS n FROM j WHERE i0 = i1 AND (s0 IS DISTINCT FROM s1 OR o0 IS DISTINCT FROM o1)")
def reconcile_row_diffs(spark, sf):
    return Q.row_differences(_copies(spark, sf), ["id", "sequence"], ["soc", "volts", "odo"]).select("id", "sequence", F.size("differences").alias("n"))


@query("topk", "SELECT id, value, n, rank FROM (SELECT id, tms_mode || '' AS value, count(*) AS n, row_number() OVER (PARTITION BY id ORDER BY count(*) DESC, tms_mode) AS rank FROM tel GROUP BY id, tms_mode) WHERE rank <= 2")
def topk(spark, sf):
    return Q.top_values(tel(spark, sf), ["id"], F.col("tms_mode"), 2)


@query("first_last_per_group", "SELECT id, arg_min(sequence, row(t_sec, sequence)) AS first_seq, arg_max(sequence, row(t_sec, sequence)) AS last_seq FROM tel GROUP BY id")
def first_last_per_group(spark, sf):
    key = F.struct("t_sec", "sequence")
    return tel(spark, sf).groupBy("id").agg(F.min_by("sequence", key).alias("first_seq"), F.max_by("sequence", key).alias("last_seq"))


@query("id_difference", "SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)")
def id_difference(spark, sf):
    """Ids without data."""
    ids = spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_custkey").alias("id"))
    return ids.join(spark.read.parquet(f"{sf}/events.parquet").select(F.col("user_id").alias("id")), "id", "left_anti")


@query("id_intersection", "SELECT DISTINCT user_id AS id FROM events WHERE user_id IN (SELECT c_custkey FROM customer)")
def id_intersection(spark, sf):
    ids = spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_custkey").alias("id"))
    return spark.read.parquet(f"{sf}/events.parquet").select(F.col("user_id").alias("id")).intersect(ids)


@query("distinct_rows", "SELECT DISTINCT event_type, strftime(ts, '%Y-%m-%d') AS day FROM events")
def distinct_rows(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet").select("event_type", F.to_date("ts").cast("string").alias("day")).distinct()


@query("union_all", "SELECT id, 'gun' AS kind, count(*) AS n FROM tel WHERE gun = 1 GROUP BY id UNION ALL SELECT id, 'brake', count(*) FROM tel WHERE brake > 0 GROUP BY id")
def union_all(spark, sf):
    df = tel(spark, sf)
    part = lambda cond, kind: df.where(cond).groupBy("id").agg(F.lit(kind).alias("kind"), F.count("*").alias("n"))
    return part("gun = 1", "gun").unionByName(part("brake > 0", "brake"))


@query("merge_metric_tables", f"SELECT id, count(*) AS rows, count(CASE WHEN {GUN} AND tmax > 35 THEN 1 END) AS hot, count(CASE WHEN tmax - tmin > 5 THEN 1 END) AS spread, count(CASE WHEN round((vmax - vmin) * 1000, 3) > 20 THEN 1 END) AS dv FROM tel GROUP BY id")
def merge_metric_tables(spark, sf):
    """What were five tables merged by vehicle is one aggregate."""
    return tel(spark, sf).groupBy("id").agg(F.count("*").alias("rows"), F.count_if(flag("gun") & (F.col("tmax") > 35)).alias("hot"), F.count_if(F.col("tmax") - F.col("tmin") > 5).alias("spread"), F.count_if(F.round((F.col("vmax") - F.col("vmin")) * 1000, 3) > 20).alias("dv"))


@query("vehicle_dim_join", "SELECT e.user_id, c.c_name, count(*) AS n FROM events e LEFT JOIN customer c ON e.user_id = c.c_custkey GROUP BY ALL")
def vehicle_dim_join(spark, sf):
    """Counts first, so the dimension joins a row for each vehicle."""
    n = spark.read.parquet(f"{sf}/events.parquet").groupBy("user_id").agg(F.count("*").alias("n"))
    c = spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_custkey").alias("user_id"), "c_name")
    return n.join(c, "user_id", "left").select("user_id", "c_name", "n")
