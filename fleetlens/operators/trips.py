"""Sites, stays and trips."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.functions.expressions import haversine_m, hms
from fleetlens.operators.timeseries import ID, SEQ, T, islands, series

#: Sites for the telemetry view (label, latitude, longitude).
SITES = [("North", 30.287722, 77.999029), ("South", 28.423090, 76.991733), ("Mid", 29.355406, 77.495381)]


def nearest_site(df: DataFrame, sites: list[tuple[str, float, float]], within_m: float = 250, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Label of the nearest site if it is within reach, else NONE; the distance always. A few literals, so no join."""
    each = [F.struct(F.round(haversine_m(F.col(lat), F.col(lon), a, b), 1).alias("m"), F.lit(label).alias("site")) for label, a, b in sites]
    known = F.col(lat).isNotNull() & F.col(lon).isNotNull()
    df = df.withColumn("__near", F.when(known, F.least(*each) if len(each) > 1 else each[0]))
    return df.withColumns({"site_m": F.col("__near.m"), "site": F.when(F.col("__near.m") <= within_m, F.col("__near.site")).otherwise("NONE")}).drop("__near")


def stays(df: DataFrame, break_on_none: bool = False) -> DataFrame:
    """(id, stay, site, arrive, depart, ...). Without break_on_none, leaving and coming back to one site is one stay."""
    if break_on_none:
        df = islands(df, F.col("site"), "stay").where("site <> 'NONE'")
    else:
        df = islands(df.where("site <> 'NONE'"), F.col("site"), "stay")
    at = F.struct(T, SEQ)
    known = F.when(F.col("odo").isNotNull(), at)
    return df.groupBy(ID, "stay").agg(F.first("site").alias("site"), F.min(T).alias("arrive"), F.max(T).alias("depart"), F.max_by("odo", known).alias("odo_out"), F.min_by("odo", known).alias("odo_in"), F.count("*").alias("rows"))


def closest_in_stay(df: DataFrame) -> DataFrame:
    """Rank by distance inside each run of one label; rows near no site have none."""
    df = islands(df, F.col("site"), "run")
    w = Window.partitionBy(ID, "run").orderBy("site_m", T, SEQ)
    return df.withColumn("site_rank", F.when(F.col("site") != "NONE", F.row_number().over(w)))


def trips(stay: DataFrame) -> DataFrame:
    """From each stay to the vehicle's next."""
    w = Window.partitionBy(ID).orderBy("arrive", "stay")
    nxt = {"to_site": F.lead("site").over(w), "reach": F.lead("arrive").over(w), "next_odo": F.lead("odo_in").over(w)}
    out = stay.withColumns(nxt).where("to_site IS NOT NULL")
    km = F.col("next_odo") - F.col("odo_out")
    return out.select(
        ID, "stay", F.concat_ws(" - ", "site", "to_site").alias("trip"), F.col("depart").alias("leave"), "reach", F.round(F.when(km >= 0, km), 3).alias("km"),
        hms(F.col("reach") - F.col("depart")).alias("travel"), hms(F.col("depart") - F.col("arrive")).alias("halt"), hms(F.col("reach") - F.col("arrive")).alias("total"),
    )


def rows_in_intervals(df: DataFrame, intervals: DataFrame, start: str = "start", end: str = "end", bucket_sec: int = 86_400) -> DataFrame:
    """Rows inside [start, end] of intervals of the same vehicle: an equi-join on vehicle and time bucket, then the range."""
    a = intervals.withColumn("__bucket", F.explode(F.sequence(F.floor(F.col(start) / bucket_sec), F.floor(F.col(end) / bucket_sec))))
    b = df.withColumn("__bucket", F.floor(F.col(T) / bucket_sec))
    return b.join(a, [ID, "__bucket"]).where(F.col(T).between(F.col(start), F.col(end))).drop("__bucket")


def tolerance_join(left: DataFrame, right: DataFrame, tolerance: int, t_left: str, t_right: str) -> DataFrame:
    """Pairs of one vehicle at most `tolerance` apart in time: each left row looks into three buckets."""
    a = left.withColumn("__b", F.explode(F.array(*[F.floor(F.col(t_left) / tolerance) + i for i in (-1, 0, 1)])))
    b = right.withColumn("__b", F.floor(F.col(t_right) / tolerance))
    return a.join(b, [ID, "__b"]).where(F.abs(F.col(t_left) - F.col(t_right)) <= tolerance).drop("__b")


def align_minute_rank(left: DataFrame, right: DataFrame, how: str = "left") -> DataFrame:
    """The n-th sample of a minute with the n-th of the same minute."""

    def ranked(df: DataFrame) -> DataFrame:
        df = df.withColumn("minute", F.floor(F.col(T) / 60))
        return df.withColumn("rn", F.row_number().over(Window.partitionBy(ID, "minute").orderBy(T, SEQ)))

    r = ranked(right).drop(T, SEQ)
    return ranked(left).join(r, [ID, "minute", "rn"], how)


def trip_energy(df: DataFrame, trip: DataFrame, regen: float = 0.8, dt_cap: float = 60) -> DataFrame:
    """Energy used, won back and idled between leaving and reaching."""
    df = df.withColumns({"__dt": F.least(F.coalesce(F.col(T) - F.lag(T).over(series()), F.lit(0)), F.lit(dt_cap)), "__dv": F.col("speed") - F.lag("speed").over(series())})
    rows = rows_in_intervals(df, trip.select(ID, "stay", "leave", "reach", "km"), "leave", "reach")
    kwh = F.col("volts") * F.col("amps") / 1000 * F.col("__dt") / 3600
    total = lambda cond, x: F.coalesce(F.sum(F.when(cond, x).cast("decimal(18,6)")).cast("double"), F.lit(0.0))
    out = rows.groupBy(ID, "stay").agg(F.first("km").alias("km"), total(kwh > 0, kwh).alias("used"), (total((kwh < 0) & (F.col("__dv") < 0), -kwh) * regen).alias("regen"), total((kwh > 0) & (F.col("speed") == 0), kwh).alias("idle"))
    net = F.col("used") - F.col("regen")
    return out.select(ID, "stay", *(F.round(c, 3).alias(f"{c}_kwh") for c in ("used", "regen", "idle")), F.round(F.when(F.col("km") >= 0.1, net / F.col("km")).otherwise(0.0), 3).alias("kwh_per_km"))
