"""Series of one vehicle: time steps, islands, fills, interpolation, odometer.

All windows lie inside one vehicle, in (time, sequence) order; ties in time fall to the sequence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

ID, T, SEQ = "id", "t_sec", "sequence"


def series(id_col: str = ID, t: str = T, seq: str = SEQ) -> WindowSpec:
    return Window.partitionBy(id_col).orderBy(t, seq)


def up_to_here(w: WindowSpec | None = None) -> WindowSpec:
    return (w if w is not None else series()).rowsBetween(Window.unboundedPreceding, 0)


def from_here(skip: int = 0) -> WindowSpec:
    """The row and those behind it, latest first, or those from `skip` rows on: what grows row by row is a running value, what shrinks isn't."""
    return Window.partitionBy(ID).orderBy(F.desc(T), F.desc(SEQ)).rowsBetween(Window.unboundedPreceding, -skip)


def step_seconds(cap: float | None = None, above: str = "zero") -> Column:
    """Seconds since the sample before, 0 for the first. Steps above the cap count 0, or the cap."""
    dt = F.coalesce(F.col(T) - F.lag(T).over(series()), F.lit(0)).cast("double")
    dt = F.greatest(dt, F.lit(0.0))
    if cap is None:
        return dt
    return F.when(dt > cap, F.lit(0.0) if above == "zero" else F.lit(float(cap))).otherwise(dt)


def dt_seconds(df: DataFrame, cap: float | None = 3, above: str = "zero", out: str = "dt") -> DataFrame:
    return df.withColumn(out, step_seconds(cap, above))


def islands(df: DataFrame, key: Column, out: str = "island", new_if: Column | None = None) -> DataFrame:
    """Numbers the runs of one key within a vehicle, from 1; new_if starts one as well."""
    df = df.withColumn("__key", key)
    change = ~F.col("__key").eqNullSafe(F.lag("__key").over(series())) | F.lag(F.lit(1)).over(series()).isNull()
    if new_if is not None:
        change = change | F.coalesce(new_if, F.lit(False))
    df = df.withColumn("__new", change.cast("int"))
    return df.withColumn(out, F.sum("__new").over(up_to_here())).drop("__key", "__new")


def fill_forward_back(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.last(c, True).over(up_to_here()), F.last(c, True).over(from_here())) for c in columns})


def fill_forward_limited(df: DataFrame, limits: dict[str, int]) -> DataFrame:
    """Last value, for at most so many rows."""
    df = df.withColumn("__rn", F.row_number().over(series()))
    out = {}
    for c, limit in limits.items():
        since = F.col("__rn") - F.last(F.when(F.col(c).isNotNull(), F.col("__rn")), True).over(up_to_here())
        out[c] = F.when(since <= limit, F.last(c, True).over(up_to_here()))
    return df.withColumns(out).drop("__rn")


def _neighbours(c: str, position: str) -> dict[str, Column]:
    known = F.when(F.col(c).isNotNull(), F.col(position))
    return {"__v0": F.last(c, True).over(up_to_here()), "__p0": F.last(known, True).over(up_to_here()), "__v1": F.last(c, True).over(from_here()), "__p1": F.last(known, True).over(from_here())}


def interpolate(df: DataFrame, c: str, by: str = "rows", limit: int | None = None, max_gap: float | None = None, edges: bool = True) -> DataFrame:
    """Linear between the known values around a null, by row position or by time.

    limit: rows filled from either end of a gap. max_gap: seconds between the known values. edges: outside the known
    range the nearest value holds (within the limit).
    """
    df = df.withColumn("__rn", F.row_number().over(series()))
    df = df.withColumns(_neighbours(c, "__rn"))
    v0, v1, p0, p1 = (F.col(x) for x in ("__v0", "__v1", "__p0", "__p1"))
    if by == "time" or max_gap is not None:
        known = F.when(F.col(c).isNotNull(), F.col(T))
        df = df.withColumns({"__t0": F.last(known, True).over(up_to_here()), "__t1": F.last(known, True).over(from_here())})
    share = (F.col(T) - F.col("__t0")) / (F.col("__t1") - F.col("__t0")) if by == "time" else (F.col("__rn") - p0) / (p1 - p0)
    inside = v0 + (v1 - v0) * share
    if max_gap is not None:
        inside = F.when(F.col("__t1") - F.col("__t0") <= max_gap, inside)
    near0, near1 = F.col("__rn") - p0 <= (limit or 0), p1 - F.col("__rn") <= (limit or 0)
    if limit is not None:
        inside = F.when(near0 | near1, inside)
    filled = F.when(F.col(c).isNotNull(), F.col(c)).when(v0.isNotNull() & v1.isNotNull(), inside)
    if edges:
        filled = filled.otherwise(F.when(v0.isNull() & (near1 if limit is not None else F.lit(True)), v1).when(v1.isNull() & (near0 if limit is not None else F.lit(True)), v0))
    return df.withColumn(c, filled).drop("__rn", "__v0", "__v1", "__p0", "__p1", "__t0", "__t1")


def impute_odo_speed(df: DataFrame, odo: str = "odo", speed: str = "speed", dt_cap: float = 3, digits: int = 3) -> DataFrame:
    """Null readings move on by speed * time from the last known one, never beyond the next; ends hold.

    Repeated clamping to the next reading is the least of it and the running distance, as no step is negative.
    """
    df = df.withColumn("__step", F.coalesce(F.col(speed) * step_seconds(dt_cap) / 3600, F.lit(0.0)))
    df = df.withColumn("__known", F.count(odo).over(up_to_here()))
    inside = Window.partitionBy(ID, "__known").orderBy(T, SEQ).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumns({"__l": F.last(odo, True).over(up_to_here()), "__r": F.last(odo, True).over(from_here()), "__run": F.sum(F.when(F.col(odo).isNull(), F.col("__step")).otherwise(0.0)).over(inside)})
    l, r = F.col("__l"), F.col("__r")
    moved = F.when(r < l, l).otherwise(F.least(l + F.col("__run"), r))
    value = F.when(F.col(odo).isNotNull(), F.col(odo)).when(l.isNull(), r).when(r.isNull(), l).otherwise(F.round(moved, digits))
    return df.withColumn(odo, value).drop("__step", "__known", "__l", "__r", "__run")


def odo_monotone(df: DataFrame, odo: str = "odo") -> DataFrame:
    return df.withColumn(odo, F.max(odo).over(up_to_here()))


def clamp_current(df: DataFrame, amps: str = "amps", limit: float = 1250) -> DataFrame:
    """Readings beyond the limit take the last valid one, or 0."""
    ok = F.when(F.abs(F.col(amps)) <= limit, F.col(amps))
    return df.withColumn(amps, F.coalesce(F.last(ok, True).over(up_to_here()), F.lit(0.0)))


def null_out_current(df: DataFrame, amps: str = "amps", limit: float = 1000, rows: int = 30) -> DataFrame:
    df = df.withColumn(amps, F.when(F.abs(F.col(amps)) <= limit, F.col(amps)))
    return fill_forward_back(interpolate(df, amps, limit=rows), [amps])
