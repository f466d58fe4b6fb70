"""Row cleaning and state of a vehicle at a sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.expressions import flag
from fleetlens.operators.timeseries import series, step_seconds, up_to_here


def charge_mode(gun: str = "gun") -> Column:
    return F.when(flag(gun), "CHARGING").otherwise("DISCHARGING")


def alt_mode(active: float = 5.0, min_speed: float = 0.5) -> Column:
    gun, amps = flag("gun"), F.col("amps")
    return F.when(gun & (amps < -active), "CHARGING_ACTIVE").when(gun & (amps >= -active), "CHARGING_IDLE").when(~gun & (F.col("speed") > min_speed) & F.col("gear").isin(1, 2), "DISCHARGING_ACTIVE").otherwise("DISCHARGING_IDLE")


def activity_state(active: float = 5.0) -> Column:
    gun, amps = flag("gun"), F.col("amps")
    return F.when(gun & (amps <= -active), "CHARGING_ACTIVE").when(gun, "CHARGING_IDLE").when(amps >= active, "DISCHARGING_ACTIVE").otherwise("DISCHARGING_IDLE")


def op_state() -> Column:
    return F.when(flag("gun"), "CHARGING").when(F.col("gear") == 2, "DRIVING").when((F.col("gear") == 0) & flag("ready") & flag("ignition"), "IDLING").otherwise("OFF")


def temp_status(low: float = 20, high: float = 35) -> Column:
    return F.when(F.col("tmin").between(low, high) & F.col("tmax").between(low, high), "SAFE").otherwise("EVALUATE")


def tms_alert(ready_over: float = 35, gun_over: float = 30) -> Column:
    hot = (flag("ready") & (F.col("tmax") > ready_over)) | (flag("gun") & (F.col("tmax") > gun_over))
    return F.coalesce(hot & (F.col("tms_mode") == "Off"), F.lit(False))


def masks(df: DataFrame) -> DataFrame:
    gun, ready, ignition = flag("gun"), flag("ready"), flag("ignition")
    return df.withColumns({"lv": ignition & ~gun & ~ready, "off": ~ignition & ~gun & ~ready, "is_ready": ready, "is_gun": gun})


def sanitize_ranges(df: DataFrame, cells: int = 576, thermocouples: int = 108) -> DataFrame:
    """Values that a sensor can't give become null."""
    c = F.col
    ok = {
        "tmax": c("tmax") >= -10, "tmin": c("tmin") >= -10, "volts": c("volts") > 0, "vmax": c("vmax") > 0, "vmin": c("vmin") > 0, "soc": c("soc") != 0,
        "tmax_no": c("tmax_no").between(1, thermocouples), "tmin_no": c("tmin_no").between(1, thermocouples), "vmax_no": c("vmax_no").between(1, cells), "vmin_no": c("vmin_no").between(1, cells),
    }
    return df.withColumns({name: F.when(rule, c(name)) for name, rule in ok.items() if name in df.columns})


def sentinel_null(df: DataFrame, columns: list[str], sentinel: float = -40, critical: list[str] | None = None) -> DataFrame:
    df = df.withColumns({c: F.nullif(F.col(c), F.lit(sentinel)) for c in columns})
    return df.na.drop(subset=critical) if critical else df


def drop_sentinel_current(df: DataFrame, sentinel: float = 3200) -> DataFrame:
    """Rows with exactly that current go; rows without a reading stay."""
    return df.where(~F.abs(F.col("amps")).eqNullSafe(F.lit(sentinel)))


def state_consistency(df: DataFrame) -> DataFrame:
    """Flags and gear that fit together; the order of the rules matters."""
    gun, ready, ignition = (F.coalesce(F.col(c) == 1, F.lit(False)) for c in ("gun", "ready", "ignition"))
    df = df.withColumns({"__gun": gun, "__ready": ready & ~gun, "__ign": ignition | gun})
    g, r, i = F.col("__gun"), F.col("__ready"), F.col("__ign")
    gear = F.when(g | ~r | ~i, 0).otherwise(F.col("gear"))
    still = g | (~g & ~r & ~i) | (r & ~i)
    speed = F.when(F.col("speed").isNull() & still, 0.0).otherwise(F.col("speed"))
    return df.withColumns({"gun": g.cast("int"), "ready": r.cast("int"), "ignition": i.cast("int"), "gear": gear, "speed": speed}).drop("__gun", "__ready", "__ign")


def anomaly_flags(df: DataFrame, spike: float = 5.0, window: int = 20) -> DataFrame:
    """odo_stuck, unrealistic_efficiency, current_spike against the vehicle's rolling median."""
    power = F.col("volts") * F.col("amps") / 1000
    ratio = power / F.col("speed")
    stuck = (F.abs(F.col("odo") - F.lag("odo").over(series())) < 0.01) & (F.col("speed") > 5) & (step_seconds() > 10)
    odd = (power > 0) & (F.col("speed") > 0.1) & ~ratio.between(0.1, 5.0)
    recent = F.sort_array(F.collect_list("amps").over(series().rowsBetween(-(window - 1), 0)))
    df = df.withColumns({"odo_stuck": F.coalesce(stuck, F.lit(False)), "unrealistic_efficiency": F.coalesce(F.when(F.col("speed") > 0.1, odd), F.lit(False)), "__recent": recent})
    n = F.size("__recent")
    middle = (F.get("__recent", F.floor((n - 1) / 2).cast("int")) + F.get("__recent", F.floor(n / 2).cast("int"))) / 2
    df = df.withColumn("__median", middle).drop("__recent")
    return df.withColumn("current_spike", F.coalesce(F.abs("amps") > spike * F.abs("__median"), F.lit(False))).drop("__median")


def soc_jump_flags(df: DataFrame, jump: float = 2, drive_rate: float = 0.10, charge_rate: float = 0.60) -> DataFrame:
    """Which of four rules a state-of-charge step breaks, and the reasons as text."""
    gun = flag("gun")
    df = df.withColumns({"__d": F.col("soc") - F.lag("soc").over(series()), "__dt": step_seconds()})
    d, rate = F.col("__d"), F.abs("__d") / F.when(F.col("__dt") > 0, F.col("__dt"))
    why = F.concat_ws(";", F.when(F.abs(d) >= jump, "jump"), F.when(~gun & (rate > drive_rate), "fast_driving"), F.when(gun & (rate > charge_rate), "fast_charging"), F.when(~gun & (d > 0), "rise_not_charging"))
    return df.withColumns({"jump_reason": why, "soc_jump": why != ""}).drop("__d", "__dt")


def soc_clean(df: DataFrame) -> DataFrame:
    """State of charge without flagged steps, carried forward. Needs soc_jump."""
    return df.withColumn("soc", F.last(F.when(~F.col("soc_jump"), F.col("soc")), True).over(up_to_here()))


def quality_filter(df: DataFrame, limit: float = 2000, key: tuple[str, ...] = ("amps", "odo", "soc")) -> DataFrame:
    df = df.where(F.abs("amps") <= limit).na.drop(subset=list(key))
    for c in ("odo_stuck", "unrealistic_efficiency", "current_spike"):
        df = df.where(~F.col(c)) if c in df.columns else df
    return df


def dedup_positive_dt(df: DataFrame) -> DataFrame:
    return df.withColumn("__dt", F.col("t_sec") - F.lag("t_sec").over(series())).where(F.col("__dt").isNull() | (F.col("__dt") > 0)).drop("__dt")
