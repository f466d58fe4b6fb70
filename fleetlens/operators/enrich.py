"""What is built on sessions: distances and rates, dead reckoning, pairs of sensors, storage rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.functions.expressions import bearing_deg, destination, flag, folded
from fleetlens.operators.timeseries import ID, SEQ, T, from_here, islands, series, step_seconds, up_to_here


def enrich_sessions(df: DataFrame, session: str = "session", max_kmph: float = 120, tolerance: float = 1.3, net_over_km: float = 20) -> DataFrame:
    """(id, session, ...): distance, speed, spreads, energy and rates; one aggregate.

    The forward distance sums rises of the odometer; the bound is what max_kmph allows. A net distance beyond
    tolerance times the bound gives way to the bound, with a reason; reasons add up, none is wiped.
    """
    inside = Window.partitionBy(ID, session).orderBy(T, SEQ)
    dt = F.coalesce(F.col(T) - F.lag(T).over(inside), F.lit(0))
    df = df.withColumns({"__dt": dt, "__up": F.greatest(F.col("odo") - F.last("odo", True).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))})
    kwh = F.col("volts") * F.col("amps") / 1000 * F.col("__dt") / 3600
    key = F.when(F.col("odo").isNotNull(), F.struct(T, SEQ))
    exact = lambda c: F.coalesce(F.sum(c.cast("decimal(18,6)")).cast("double"), F.lit(0.0))
    moving = F.when(F.col("speed") > 0.1, F.col("speed"))
    dv, dtemp = (F.col("vmax") - F.col("vmin")) * 1000, F.col("tmax") - F.col("tmin")
    out = df.groupBy(ID, session).agg(
        (F.max_by("odo", key) - F.min_by("odo", key)).alias("net_km"), exact(F.col("__up")).alias("forward_km"), F.median(moving).alias("moving_median"), F.max("speed").alias("speed_max"),
        F.percentile(dv, 0.95).alias("dv_p95"), F.max(dtemp).alias("spread_max"), exact(F.when(kwh > 0, kwh)).alias("used"), exact(F.when(kwh < 0, -kwh)).alias("regen"), (F.sum("__dt") / 3600 * max_kmph).alias("bound"),
    )
    too_far = F.coalesce(F.col("net_km") > tolerance * F.col("bound"), F.lit(False))
    back = F.coalesce(F.col("net_km") < 0, F.lit(False))
    km = F.when(too_far, F.col("bound")).when(back, F.col("forward_km")).otherwise(F.coalesce("net_km", F.lit(0.0)))
    out = out.withColumns({"km": km, "reasons": F.concat_ws(";", F.when(too_far, "beyond_physics"), F.when(back, "odometer_back"))})
    return out.select(
        ID, session, F.round("km", 3).alias("km"), F.round("forward_km", 3).alias("forward_km"), "reasons", "moving_median", "speed_max", F.round("dv_p95", 3).alias("dv_p95"), "spread_max",
        F.round(F.when(F.col("km") > 0, F.col("used") / F.col("km")).otherwise(0.0), 3).alias("kwh_per_km"), F.round(F.when(F.col("km") > net_over_km, (F.col("used") - F.col("regen")) / F.col("km")).otherwise(0.0), 3).alias("net_kwh_per_km"),
    )


def impute_odo_deadreckon(df: DataFrame, odo: str = "odo", dt_cap: float = 60) -> DataFrame:
    """Null readings move on from the last known one by speed and time; nothing before the first."""
    step = F.coalesce(F.col("speed") * step_seconds(dt_cap) / 3600, F.lit(0.0))
    df = df.withColumns({"__step": step, "__known": F.count(odo).over(up_to_here())})
    inside = Window.partitionBy(ID, "__known").orderBy(T, SEQ).rowsBetween(Window.unboundedPreceding, 0)
    run = F.sum(F.when(F.col(odo).isNull(), F.col("__step")).otherwise(0.0)).over(inside)
    return df.withColumn(odo, F.coalesce(F.col(odo), F.last(odo, True).over(up_to_here()) + run)).drop("__step", "__known")


def gps_deadreckon(df: DataFrame) -> DataFrame:
    """(id, sequence, lat, lon): between two fixes, points go on along the bearing from the first to the second, by speed and time.

    The rows between two fixes are a group of their own; its steps are folded one after the other, as each begins where the
    one before ended. Rows before the first fix and behind the last stay as they are.
    """
    fix = F.coalesce(~F.isnan("lat") & ~F.isnan("lon"), F.lit(False)) & F.col("lat").isNotNull() & F.col("lon").isNotNull()
    at = F.when(fix, F.struct("lat", "lon"))
    meters = F.coalesce(F.nanvl("speed", F.lit(0.0)), F.lit(0.0)) / 3.6 * step_seconds()
    rows = df.select(ID, T, SEQ, "lat", "lon", fix.alias("fix"), meters.alias("m"), F.count(at).over(up_to_here()).alias("gap"), F.last(at, True).over(up_to_here()).alias("from"), F.last(at, True).over(from_here(1)).alias("to"))
    lost = ~F.col("fix") & F.col("from").isNotNull() & F.col("to").isNotNull()
    gaps = rows.where(lost).groupBy(ID, "gap").agg(F.first("from").alias("from"), F.first("to").alias("to"), F.sort_array(F.collect_list(F.struct(T, SEQ, "m"))).alias("steps"))
    gaps = gaps.withColumn("bearing", bearing_deg(F.col("from.lat"), F.col("from.lon"), F.col("to.lat"), F.col("to.lon")))

    def onward(place: Column, step: Column) -> Column:
        lat, lon = destination(place["lat"], place["lon"], F.col("bearing"), step["m"])
        return F.struct(lat.alias("lat"), lon.alias("lon"))

    places = folded(F.col("steps"), F.struct(F.col("from.lat").alias("lat"), F.col("from.lon").alias("lon")), onward, "struct<lat:double,lon:double>")
    found = gaps.select(ID, F.explode(F.arrays_zip("steps", places.alias("places"))).alias("x")).select(ID, f"x.steps.{SEQ}", "x.places.lat", "x.places.lon")
    return rows.where(~lost).select(ID, SEQ, "lat", "lon").unionByName(found)


def stop_to_stop_trips(df: DataFrame) -> DataFrame:
    """On-road runs between stops at two different sites. Needs site and speed."""
    place = F.when((F.col("speed") == 0) & (F.col("site") != "NONE"), F.col("site")).otherwise("ON_ROAD")
    runs = islands(df.withColumn("place", place), F.col("place"), "run")
    runs = runs.groupBy(ID, "run").agg(F.first("place").alias("place"), F.min(T).alias("start"), F.max(T).alias("end"), F.count("*").alias("rows"))
    w = Window.partitionBy(ID).orderBy("run")
    runs = runs.withColumns({"origin": F.lag("place").over(w), "target": F.lead("place").over(w)})
    return runs.where("place = 'ON_ROAD' AND origin <> 'ON_ROAD' AND target <> 'ON_ROAD' AND origin <> target").select(ID, "run", "origin", "target", "start", "end", "rows")


def sweep_values(df: DataFrame, cycles: DataFrame, sensor: str, value: str) -> DataFrame:
    """(id, cycle, sensor, value): the last value of each sensor inside each cycle."""
    from fleetlens.operators.trips import rows_in_intervals

    rows = rows_in_intervals(df.where(F.col(value).isNotNull()), cycles.select(ID, "cycle", "start", "end"))
    return rows.groupBy(ID, "cycle", sensor).agg(F.max_by(value, F.struct(T, SEQ)).alias("value"))


def comissing_pairs(df: DataFrame, columns: list[str], over: float = 0.7) -> DataFrame:
    """(a, b, r): correlation of two columns' missing flags, where it is beyond `over`. Every row counts."""
    from fleetlens.operators.quality import correlations

    flags = df.select(*(F.col(c).isNull().cast("double").alias(c) for c in columns))
    return correlations(flags, columns).where(F.abs("r") > over)


#: Storage rules by name pattern: type, scale, category. The first that matches counts.
STORAGE_RULES = [("odo", "bigint", 1000.0, "distance_m"), ("^v(max|min)$", "int", 1000.0, "cell_mv"), ("^t(max|min)$", "decimal(4,1)", 1.0, "temperature"), ("soc|soh", "decimal(4,1)", 1.0, "percent"), ("_no$", "smallint", 1.0, "sensor"), ("volts|amps|speed", "decimal(12,3)", 1.0, "analogue")]


def dtype_rules(df: DataFrame) -> DataFrame:
    """(column, found, type, scale, category): the rule of each column; unmapped ones have none."""
    kinds = df.sparkSession.createDataFrame([(c, k) for c, k in df.dtypes], "column string, found string")
    pick = lambda i: F.coalesce(*(F.when(F.col("column").rlike(r[0]), F.lit(r[i])) for r in STORAGE_RULES))
    return kinds.select("column", "found", F.coalesce(pick(1), F.lit("UNMAPPED")).alias("type"), pick(2).alias("scale"), pick(3).alias("category"))


def apply_storage_scaling(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns in their storage type: scaled, rounded half to even, null where they don't fit."""
    import re

    out = {}
    for c in columns:
        rule = next((r for r in STORAGE_RULES if re.search(r[0], c)), None)
        if rule:
            digits = int(m[1]) if (m := re.search(r",(\d+)\)", rule[1])) else 0
            out[c] = F.bround(F.col(c) * rule[2], digits).try_cast(rule[1])
    return df.withColumns(out)


def gap_status(df: DataFrame, gaps: DataFrame, sluggish: float = 5) -> DataFrame:
    """Whether the heartbeat stood still, moved little, or went on during each gap."""
    from fleetlens.operators.trips import rows_in_intervals

    rows = rows_in_intervals(df, gaps).groupBy(ID, "gap").agg(F.count_distinct("beat").alias("beats"), (F.max("beat") - F.min("beat")).alias("range"))
    status = F.when(F.col("beats") <= 1, "frozen").when(F.col("range") < sluggish, "sluggish").otherwise("active_but_mute")
    return rows.select(ID, "gap", "beats", status.alias("status"))


def drive_charge_idle(gun: Column | None = None) -> Column:
    gun = flag("gun") if gun is None else gun
    return F.when(gun, "Charging-Park").when(F.col("speed") > 0, "Drive").otherwise("Idle-Other")
