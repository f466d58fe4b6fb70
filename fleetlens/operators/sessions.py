"""Sessions, periods and events: gaps and islands over a vehicle's series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.functions.expressions import flag
from fleetlens.operators.timeseries import ID, SEQ, T, fill_forward_back, from_here, islands, series, step_seconds, up_to_here
from fleetlens.operators.trips import rows_in_intervals


def gap_seconds() -> Column:
    return F.col(T) - F.lag(T).over(series())


def mode_gap_sessions(df: DataFrame, mode: Column, max_gap_sec: float = 300, out: str = "session") -> DataFrame:
    """A session ends where the mode changes or a gap is longer than max_gap_sec."""
    return islands(df, mode, out, gap_seconds() > max_gap_sec)


def charging_envelopes(df: DataFrame, mode: str = "mode", merge_min: float = 15) -> DataFrame:
    """(id, envelope, start, end): runs of charging modes, joined where the pause is at most merge_min minutes."""
    runs = islands(df, F.col(mode).startswith("CHARGING"), "__run").where(F.col(mode).startswith("CHARGING"))
    runs = runs.groupBy(ID, "__run").agg(F.min(T).alias("start"), F.max(T).alias("end"))
    w = Window.partitionBy(ID).orderBy("start")
    new = F.coalesce((F.col("start") - F.lag("end").over(w) > merge_min * 60).cast("int"), F.lit(1))
    runs = runs.withColumn("__new", new).withColumn("envelope", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(ID, "envelope").agg(F.min("start").alias("start"), F.max("end").alias("end"))


def day_segments(df: DataFrame, mode: str = "mode", merge_min: float = 15, out: str = "segment") -> DataFrame:
    """Rows numbered by segment: inside one envelope, or between two."""
    charging = F.col(mode).startswith("CHARGING")
    before = F.last(F.when(charging, F.col(T)), True).over(up_to_here())
    after = F.last(F.when(charging, F.col(T)), True).over(from_here())
    # between two charging rows that one envelope joins
    inside = charging | F.coalesce(after - before <= merge_min * 60, F.lit(False))
    return islands(df.withColumn("__in", inside), F.col("__in"), out).drop("__in")


def session_metrics(df: DataFrame, session: str = "session", min_rows: int = 2) -> DataFrame:
    """(id, session, ...) with time, energy, state of charge and shares of time; each row has the time before it."""
    inside = Window.partitionBy(ID, session).orderBy(T, SEQ)
    df = df.withColumn("__dt", F.coalesce(F.col(T) - F.lag(T).over(inside), F.lit(0)))
    kwh = F.col("volts") * F.col("amps") * F.col("__dt") / 3.6e6
    exact = lambda c: F.sum(c.cast("decimal(18,6)")).cast("double")
    share = lambda cond: F.round(100 * F.sum(F.when(cond, F.col("__dt")).otherwise(0)) / F.nullif(F.sum("__dt"), F.lit(0)), 2)
    key = F.struct(T, SEQ)
    out = df.groupBy(ID, session).agg(
        F.count("*").alias("rows"),
        F.min(T).alias("start"),
        F.max(T).alias("end"),
        F.round((F.max(T) - F.min(T)) / 60, 2).alias("minutes"),
        F.round(F.coalesce(exact(F.when(kwh < 0, -kwh)), F.lit(0.0)), 3).alias("kwh_in"),
        F.round(F.coalesce(exact(F.when(kwh > 0, kwh)), F.lit(0.0)), 3).alias("kwh_out"),
        F.min_by("soc", key).alias("soc_start"),
        F.max_by("soc", key).alias("soc_end"),
        share(F.col("amps") < 0).alias("charging_pct"),
        share(F.col("amps") > 0).alias("discharging_pct"),
        share(F.col("speed") > 0).alias("motion_pct"),
        share(flag("gun")).alias("gun_pct"),
        F.avg(F.when(flag("gun"), 1.0).otherwise(0.0)).alias("gun_share"),
        F.avg(F.col("amps").cast("decimal(18,6)")).cast("double").alias("mean_amps"),
    )
    return out.where(F.col("rows") >= min_rows)


def session_activity() -> Column:
    """The activity of a row of session_metrics."""
    gun, amps = F.col("gun_share") > 0.5, F.col("mean_amps")
    return F.when(gun & (amps < 0), "CHARGING_ACTIVE").when(gun, "CHARGING_IDLE").when(amps > 0, "DISCHARGING_ACTIVE").otherwise("DISCHARGING_IDLE")


def glitch(activity: Column, drop: Column) -> Column:
    """Reason, where a charging session loses state of charge; else null."""
    limit = F.when(activity == "CHARGING_ACTIVE", 0.0).when(activity == "CHARGING_MAINTAIN", 0.3).when(activity == "CHARGING_IDLE", 0.5)
    return F.when(drop > limit, F.concat(F.lit("soc_drop_in_"), activity))


def missing_gaps(sessions: DataFrame, day_sec: int = 86_400, min_minutes: float = 2) -> DataFrame:
    """(id, day, start, end): times of a UTC day that no session covers, of at least min_minutes. Sessions lie inside a day."""
    s = sessions.withColumn("day", F.floor(F.col("start") / day_sec))
    w = Window.partitionBy(ID, "day").orderBy("start", "end")
    covered = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, 0))
    s = s.withColumns({"__from": covered, "__to": F.lead("start").over(w), "__first": F.row_number().over(w) == 1})
    edge = F.when(F.col("__first"), F.array(F.struct((F.col("day") * day_sec).alias("start"), F.col("start").alias("end")))).otherwise(F.array().cast("array<struct<start:bigint,end:bigint>>"))
    gap = F.array(F.struct(F.col("__from").alias("start"), F.coalesce("__to", (F.col("day") + 1) * day_sec).alias("end")))
    return s.select(ID, "day", F.explode(F.concat(edge, gap)).alias("g")).select(ID, "day", "g.start", "g.end").where(F.col("end") - F.col("start") >= min_minutes * 60)


def charging_sessions(df: DataFrame, on: Column, merge_min: float = 5, merge_soc: float = 1, always_sec: float = 60, capacity_kwh: float = 423) -> DataFrame:
    """Plugged runs, joined when the pause is short and the charge hardly moved, or very short; energy by trapezoids."""
    power = F.col("volts") * F.col("amps") / 1000
    area = (power + F.lag(power).over(series())) / 2 * step_seconds() / 3600
    df = df.withColumns({"__on": on, "__area": F.coalesce(area, F.lit(0.0))})
    runs = islands(df, F.col("__on"), "__run").where("__on")
    key = F.struct(T, SEQ)
    runs = runs.groupBy(ID, "__run").agg(F.min(T).alias("start"), F.max(T).alias("end"), F.min_by("soc", key).alias("soc_start"), F.max_by("soc", key).alias("soc_end"), F.sum(F.col("__area").cast("decimal(18,6)")).alias("kwh"))
    w = Window.partitionBy(ID).orderBy("start")
    pause, moved = F.col("start") - F.lag("end").over(w), F.abs(F.col("soc_start") - F.lag("soc_end").over(w))
    joined = (pause <= always_sec) | ((pause <= merge_min * 60) & (moved <= merge_soc))
    runs = runs.withColumn("__new", F.when(F.coalesce(joined, F.lit(False)), 0).otherwise(1))
    runs = runs.withColumn("session", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = runs.groupBy(ID, "session").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("soc_start", "start").alias("soc_start"), F.max_by("soc_end", "start").alias("soc_end"), F.round(F.sum("kwh").cast("double"), 3).alias("kwh"))
    return out.withColumn("soc_kwh", F.round(F.abs(F.col("soc_end") - F.col("soc_start")) / 100 * capacity_kwh, 3))


def charging_by_contactor(df: DataFrame, contactor: str, full: float = 100, capacity_kwh: float = 423) -> DataFrame:
    """(id, session, start, end, soc_start, soc_end, seconds, full_sec, kwh, soc_kwh, apart_pct) of sessions that a charging contactor drives.

    Rows with the current's sentinel go, zero charge and voltage are filled, a missing current counts 0, rows without the contactor
    don't count. seconds, kwh and full_sec (time until the charge is full, for sessions that end so) are those of
    the plugged rows; apart_pct compares both energies to their mean. Sessions that end with the charge they began with are left out.
    """
    df = df.where(~F.abs(F.col("amps")).eqNullSafe(F.lit(3200.0)))
    df = fill_forward_back(df.withColumns({c: F.nullif(F.col(c), F.lit(0.0)) for c in ("soc", "volts")}), ["soc", "volts"])
    df = df.withColumn("amps", F.coalesce("amps", F.lit(0.0))).na.drop(subset=["soc", "volts", contactor])
    found = charging_sessions(df, F.col(contactor) == 1, capacity_kwh=capacity_kwh).select(ID, "session", "start", "end", "soc_start", "soc_end", "soc_kwh").where("soc_start <> soc_end")
    plugged = rows_in_intervals(df.where(flag("gun")), found.select(ID, "session", "start", "end"))
    w = Window.partitionBy(ID, "session").orderBy(T, SEQ)
    power = F.col("volts") * F.abs("amps") / 1000
    plugged = plugged.withColumn("__kwh", (power + F.lag(power).over(w)) / 2 * (F.col(T) - F.lag(T).over(w)) / 3600)
    sums = plugged.groupBy(ID, "session").agg((F.max(T) - F.min(T)).alias("seconds"), (F.min(F.when(F.col("soc") >= full, F.col(T))) - F.min(T)).alias("full_sec"), F.sum(F.col("__kwh").cast("decimal(18,6)")).cast("double").alias("kwh"))
    out = found.join(sums, [ID, "session"], "left").withColumn("kwh", F.coalesce("kwh", F.lit(0.0)))
    # the charge may fall while plugged: the change counts with its sign
    soc_kwh = (F.col("soc_end") - F.col("soc_start")) * capacity_kwh / 100
    both = F.col("kwh") + soc_kwh
    return out.select(
        ID, "session", "start", "end", "soc_start", "soc_end", F.coalesce("seconds", F.lit(0)).cast("long").alias("seconds"), F.when(F.col("soc_end") >= full, F.col("full_sec")).alias("full_sec"),
        F.round("kwh", 3).alias("kwh"), F.round(soc_kwh, 3).alias("soc_kwh"), F.round(F.when(both != 0, 100 * F.abs(F.col("kwh") - soc_kwh) / (both / 2)).otherwise(0.0), 2).alias("apart_pct"),
    )


def mode_sessions_report(df: DataFrame, mode: Column, buckets: dict[str, tuple[Column, list[str]]]) -> DataFrame:
    """(id, session, mode, start, end, minutes, <name>_<i>...) of each run of a mode; <name>_<i> is the share of the rows with a bucket that the i-th label of it holds, in per cent."""
    df = islands(df.withColumn("mode", mode), F.col("mode"), "session")
    df = df.withColumns({f"__{name}": bucket for name, (bucket, _) in buckets.items()})
    shares = [F.round(100 * F.count_if(F.col(f"__{name}") == label) / F.nullif(F.count(f"__{name}"), F.lit(0)), 2).alias(f"{name}_{i}") for name, (_, labels) in buckets.items() for i, label in enumerate(labels)]
    return df.groupBy(ID, "session").agg(F.min("mode").alias("mode"), F.min(T).alias("start"), F.max(T).alias("end"), F.round((F.max(T) - F.min(T)) / 60, 2).alias("minutes"), *shares)


def soc_accuracy_sessions(df: DataFrame, mode: Column, capacity_kwh: float = 423, max_gap_sec: float = 300, active: float = 10, dt_cap: float = 60) -> DataFrame:
    """Energy by state of charge against measured energy, for each session with two rows and an active one."""
    df = mode_gap_sessions(df.withColumn("mode", mode), F.col("mode"), max_gap_sec)
    inside = Window.partitionBy(ID, "session").orderBy(T, SEQ)
    dt = F.least(F.coalesce(F.col(T) - F.lag(T).over(inside), F.lit(0)), F.lit(dt_cap))
    df = df.withColumn("__kwh", F.when(F.abs("amps") > active, F.col("volts") * F.col("amps") * dt / 3.6e6))
    key = F.struct(T, SEQ)
    out = df.groupBy(ID, "session").agg(
        F.first("mode").alias("mode"), F.count("*").alias("rows"), F.count("__kwh").alias("active_rows"),
        F.abs(F.max_by("soc", key) - F.min_by("soc", key)).alias("__d"), F.avg("soh").alias("__soh"), F.abs(F.sum(F.col("__kwh").cast("decimal(18,6)"))).cast("double").alias("__kwh"),
    )
    out = out.where("rows >= 2 AND active_rows > 0").withColumn("__soc", F.col("__d") * F.col("__soh") * capacity_kwh / 1e4)
    accuracy = F.when(F.col("__soc") > 0, (1 - F.abs(F.col("__soc") - F.col("__kwh")) / F.col("__soc")) * 100)
    return out.select(ID, "session", "mode", "rows", F.round("__soc", 3).alias("soc_kwh"), F.round("__kwh", 3).alias("measured_kwh"), F.round(accuracy, 2).alias("accuracy_pct"))


def op_state_sessions(df: DataFrame, state: Column) -> DataFrame:
    df = islands(df.withColumn("state", state), F.col("state"), "session").where("state <> 'OFF'")
    key = F.struct(T, SEQ)
    known = F.when(F.col("odo").isNotNull(), key)
    return df.groupBy(ID, "session").agg(F.first("state").alias("state"), F.min(T).alias("start"), F.max(T).alias("end"), F.min_by("odo", known).alias("odo_start"), F.max_by("odo", known).alias("odo_end"))


def alert_periods(df: DataFrame, alert: Column, apart_sec: float = 120, min_sec: float = 300) -> DataFrame:
    """Alert rows at most apart_sec apart form a period; kept if it lasts min_sec."""
    df = df.where(alert)
    df = islands(df, F.lit(1), "period", gap_seconds() > apart_sec)
    kind = F.when(F.max(F.when(flag("gun"), 1).otherwise(0)) == 1, "charging").otherwise("motion")
    out = df.groupBy(ID, "period").agg(F.min(T).alias("start"), F.max(T).alias("end"), F.count("*").alias("rows"), F.max("tmax").alias("hottest"), kind.alias("kind"))
    return out.where(F.col("end") - F.col("start") >= min_sec)


def state_transitions(df: DataFrame, command: str = "command", mode: str = "tms_mode") -> DataFrame:
    """Rows where the command or the mode changes, and which; before the first row both are Unknown."""
    df = df.withColumns({f"prev_{c}": F.coalesce(F.lag(c).over(series()), F.lit("Unknown")) for c in (command, mode)})
    a, b = (~F.col(c).eqNullSafe(F.col(f"prev_{c}")) for c in (command, mode))
    return df.where(a | b).withColumn("kind", F.when(a & b, "both").when(a, "cmd_only").otherwise("mode_only"))


def state_groups(df: DataFrame, key: Column) -> DataFrame:
    """Runs of one state: time, temperatures at start and end, median, active minutes by the time after each row."""
    df = df.withColumns({"__state": key, "__next": F.coalesce(F.lead(T).over(series()) - F.col(T), F.lit(0))})
    df = islands(df, F.col("__state"), "group")
    at = F.struct(T, SEQ)
    return df.groupBy(ID, "group").agg(
        F.first("__state").alias("state"), F.min(T).alias("start"), F.max(T).alias("end"), F.count("*").alias("rows"), F.min_by("tmax", at).alias("t_start"), F.max_by("tmax", at).alias("t_end"),
        F.median("tmax").alias("t_median"), F.mode("tmax", True).alias("t_mode"), F.round(F.sum(F.when(F.col("amps") != 0, F.col("__next")).otherwise(0)) / 60, 3).alias("active_min"),
    )


def cooling_response(df: DataFrame, over: float = 35) -> DataFrame:
    """Seconds from the first row above the limit to the next below it, for each entry."""
    hot = F.col("tmax") > over
    below = F.min(F.when(F.col("tmax") < over, F.col(T))).over(from_here(1))
    df = df.withColumns({"__entry": hot & ~F.coalesce(F.lag(hot).over(series()), F.lit(False)), "exit": below}).where("__entry AND exit IS NOT NULL")
    first = df.groupBy(ID, "exit").agg(F.min(T).alias("entry"))
    return first.select(ID, "entry", "exit", (F.col("exit") - F.col("entry")).alias("seconds"))


def brake_stops(df: DataFrame, top_speed: float = 30, search_sec: int = 10) -> DataFrame:
    """(id, stop, start, ...): stops whose braking began within search_sec before and peaked at top_speed or more."""
    back = Window.partitionBy(ID).orderBy(T).rangeBetween(-search_sec, 0)
    stop = (F.col("speed") == 0) & (F.lag("speed").over(series()) > 0)
    pressed = F.min(F.when(F.col("brake") > 0, F.col(T))).over(back)
    df = df.withColumns({"__stop": stop, "__start": pressed})
    stops = df.where("__stop AND __start IS NOT NULL").select(ID, F.col(T).alias("stop"), F.col("__start").alias("start"), F.col(SEQ).alias("__seq"))
    # the rows from the press to the stop: buckets of search_sec seconds make it an equi-join
    bucket = lambda t: F.floor(t / max(1, search_sec))
    buckets = F.explode(F.sequence(bucket(F.col("start")), bucket(F.col("stop"))))
    rows = df.select(F.col(ID).alias("__id"), T, SEQ, "speed", "brake", bucket(F.col(T)).alias("__at"))
    near = stops.withColumn("__bucket", buckets).join(rows, (F.col(ID) == F.col("__id")) & (F.col("__bucket") == F.col("__at")))
    near = near.where((F.col(T) >= F.col("start")) & (F.struct(T, SEQ) <= F.struct("stop", "__seq")))
    out = near.groupBy(ID, "stop", "start", "__seq").agg(F.max("speed").alias("peak_speed"), F.min_by("speed", F.struct(T, SEQ)).alias("start_speed"), F.max("brake").alias("max_brake"), F.count("*").cast("int").alias("rows"))
    return out.where(F.col("peak_speed") >= top_speed).drop("__seq")


def brake_metrics(stops: DataFrame, mass_kg: float = 13_500) -> DataFrame:
    """Mean deceleration from the peak, and the force it takes."""
    slow = F.col("peak_speed") / 3.6 / F.nullif(F.col("stop") - F.col("start"), F.lit(0))
    return stops.withColumns({"deceleration": F.round(slow, 4), "force_kgf": F.round(mass_kg * slow / 9.80665, 2)})


def brake_runs(df: DataFrame, gap_sec: float = 1, low: float = 0, high: float = 200) -> DataFrame:
    """Runs of braking in gear that come to a stop, by speed at their start."""
    df = islands(df.where("brake > 0"), F.lit(1), "run", gap_seconds() > gap_sec)
    out = df.groupBy(ID, "run").agg(F.min(T).alias("start"), F.max(T).alias("end"), F.min_by("speed", F.struct(T, SEQ)).alias("start_speed"), F.min("speed").alias("least_speed"), F.count("*").alias("rows"))
    return out.where((F.col("least_speed") == 0) & F.col("start_speed").between(low, high))
