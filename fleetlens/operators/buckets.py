"""Distributions: buckets, occupancy, hotspots, mileage by period."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.functions import expressions as X
from fleetlens.operators.timeseries import ID, T, series


def temperature_bucket() -> Column:
    return X.bucket(F.col("tmax"), X.TEMP_EDGES, X.TEMP_LABELS)


def spread_bucket() -> Column:
    return X.bucket(F.col("tmax") - F.col("tmin"), X.DT_EDGES, X.DT_LABELS)


def millivolt_bucket() -> Column:
    """The lowest edge belongs to the first bin."""
    return X.bucket(F.round((F.col("vmax") - F.col("vmin")) * 1000, 3), X.DV_EDGES, X.DV_LABELS, 0, True)


def soc_bucket(c: str = "soc") -> Column:
    return X.bucket(F.col(c), X.SOC_EDGES, X.SOC_LABELS, 0)


def share_of_rows(df: DataFrame, by: list[str], bucket: Column, labels: list[str], digits: int = 2) -> DataFrame:
    """Per cent of the rows that have a bucket, one column for each fixed label; one pass, no pivot."""
    df = df.withColumn("__b", bucket)
    n = F.nullif(F.count("__b"), F.lit(0))
    return df.groupBy(*by).agg(*(F.round(100 * F.count_if(F.col("__b") == name) / n, digits).alias(f"pct_{i}") for i, name in enumerate(labels)))


def fleet_mean(shares: DataFrame, by: list[str], labels: list[str], digits: int = 2) -> DataFrame:
    """Each vehicle weighs the same: sums of its percentages, made to add to 100."""
    sums = shares.groupBy(*by).agg(*(F.sum(F.col(f"pct_{i}").cast("decimal(18,2)")).alias(f"pct_{i}") for i in range(len(labels))))
    total = sum((F.coalesce(F.col(f"pct_{i}"), F.lit(0)) for i in range(1, len(labels))), F.coalesce(F.col("pct_0"), F.lit(0)))
    return sums.select(*by, *(F.round(100 * F.col(f"pct_{i}").cast("double") / total.cast("double"), digits).alias(f"pct_{i}") for i in range(len(labels))))


def share_of_time(df: DataFrame, by: list[str], bucket: Column, cap: float = 300, digits: int = 2) -> DataFrame:
    """Per cent of the time within `by` that each bucket holds; steps are cut to the cap."""
    dt = F.least(F.coalesce(F.col(T) - F.lag(T).over(series()), F.lit(0)), F.lit(cap))
    df = df.withColumns({"__dt": dt, "bucket": bucket}).where("bucket IS NOT NULL")
    sums = df.groupBy(*by, "bucket").agg(F.sum("__dt").alias("seconds"))
    return sums.select(*by, "bucket", F.round(100 * F.col("seconds") / F.nullif(F.sum("seconds").over(Window.partitionBy(*by)), F.lit(0)), digits).alias("pct"))


def hotspots(df: DataFrame, by: list[str], kinds: dict[str, str], weight: Column | None = None) -> DataFrame:
    """How often (or how long) each sensor is the extreme one: (by..., kind, sensor, n, pct of the kind)."""
    df = df.withColumn("__w", weight if weight is not None else F.lit(1))
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(c).alias("sensor")) for k, c in kinds.items())))
    long = df.select(*by, "__w", each.alias("x")).select(*by, "__w", "x.kind", "x.sensor").where("sensor IS NOT NULL")
    out = long.groupBy(*by, "kind", "sensor").agg(F.sum("__w").alias("n"))
    return out.withColumn("pct", F.round(100 * F.col("n") / F.nullif(F.sum("n").over(Window.partitionBy(*by, "kind")), F.lit(0)), 2))


def extremes_side_by_side(df: DataFrame, sensor_max: str, sensor_min: str) -> DataFrame:
    """(sensor, max_n, min_n) with 0 where a sensor is never the one or the other: one pass instead of an outer join."""
    each = F.explode(F.array(F.struct(F.lit(1).alias("hi"), F.lit(0).alias("lo"), F.col(sensor_max).alias("sensor")), F.struct(F.lit(0).alias("hi"), F.lit(1).alias("lo"), F.col(sensor_min).alias("sensor"))))
    return df.select(each.alias("x")).where("x.sensor IS NOT NULL").groupBy(F.col("x.sensor").alias("sensor")).agg(F.sum("x.hi").alias("max_n"), F.sum("x.lo").alias("min_n"))


def mileage_steps(df: DataFrame) -> DataFrame:
    """step_sec, step_km and step_speed: time, odometer and speed since the vehicle's sample before; no distance is negative."""
    before = {c: F.lag(c).over(series()) for c in (T, "odo", "speed")}
    return df.withColumns({"step_sec": F.coalesce(F.col(T) - before[T], F.lit(0)), "step_km": F.greatest(F.col("odo") - before["odo"], F.lit(0.0)), "step_speed": F.col("speed") - before["speed"]})


def mileage_totals(steps: DataFrame, by: list[Column | str], period_sec: int, least_km: float = 0.1, dt_cap: float = 300, regen: float = 0.8) -> DataFrame:
    """(by..., km, used_kwh, ...) of samples with their steps. by names the vehicle and the period; works on streams as well."""
    seconds = F.when(F.col("step_sec") <= dt_cap, F.col("step_sec")).otherwise(0)
    kwh = F.col("volts") * F.col("amps") / 1000 * seconds / 3600
    total = lambda cond, x: F.coalesce(F.sum(F.when(cond, x).cast("decimal(18,6)")).cast("double"), F.lit(0.0))
    out = steps.groupBy(*by).agg(
        total(F.lit(True), F.col("step_km")).alias("km"), total((kwh > 0) & (F.col("speed") > 0), kwh).alias("used"), (regen * total((kwh < 0) & (F.col("step_speed") < 0), -kwh)).alias("regen"),
        total((kwh > 0) & (F.col("speed") == 0), kwh).alias("idle"), F.count("*").alias("rows"), F.count_if(F.col("amps").isNotNull() & F.col("odo").isNotNull()).alias("usable"),
    )
    net = F.col("used") - F.col("regen")
    return out.select(
        *out.columns[: len(by)], F.round("km", 3).alias("km"), F.round("used", 3).alias("used_kwh"), F.round("regen", 3).alias("regen_kwh"), F.round("idle", 3).alias("idle_kwh"), F.round(net, 3).alias("net_kwh"),
        F.round(F.when(F.col("km") >= least_km, net / F.col("km")), 3).alias("kwh_per_km"), F.round(100 * F.col("rows") / period_sec, 3).alias("rows_pct"), F.round(100 * F.col("usable") / period_sec, 3).alias("usable_pct"),
    )


def mileage_energy(df: DataFrame, period_sec: int, least_km: float = 0.1, dt_cap: float = 300, regen: float = 0.8) -> DataFrame:
    """Distance and energy of each vehicle and period; periods begin at multiples of period_sec."""
    return mileage_totals(mileage_steps(df), [ID, (F.floor(F.col(T) / period_sec) * period_sec).alias("period")], period_sec, least_km, dt_cap, regen)
