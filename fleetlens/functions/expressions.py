"""Column expressions: flags, geography, rounding, durations, buckets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0
TRUE_WORDS = ("1", "true", "yes", "y", "connected", "on")


def flag(c: str | Column, extra: tuple[str, ...] = ()) -> Column:
    """TRUE for the number 1 or one of the words for yes; null is FALSE."""
    c = F.col(c) if isinstance(c, str) else c
    number = F.coalesce(c.cast("string").try_cast("double") == 1, F.lit(False))
    return number | F.coalesce(F.lower(F.trim(c.cast("string"))).isin(*TRUE_WORDS, *extra), F.lit(False))


def within(c: str, low: float | None = None, high: float | None = None, strict_low: bool = False) -> Column:
    """The value, or null outside the range."""
    x = F.col(c)
    ok = F.lit(True)
    if low is not None:
        ok = ok & (x > low if strict_low else x >= low)
    if high is not None:
        ok = ok & (x <= high)
    return F.when(ok, x)


def haversine_m(lat1: Column, lon1: Column, lat2: Column | float, lon2: Column | float) -> Column:
    lat2, lon2 = (x if isinstance(x, Column) else F.lit(x) for x in (lat2, lon2))
    p1, p2 = F.radians(lat1), F.radians(lat2)
    a = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_M * F.asin(F.sqrt(a))


def bearing_deg(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    p1, p2, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    y, x = F.sin(d) * F.cos(p2), F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(d)
    return F.pmod(F.degrees(F.atan2(y, x)), F.lit(360.0))


def destination(lat: Column, lon: Column, bearing: Column, meters: Column) -> tuple[Column, Column]:
    p, b, r = F.radians(lat), F.radians(bearing), meters / EARTH_M
    p2 = F.asin(F.sin(p) * F.cos(r) + F.cos(p) * F.sin(r) * F.cos(b))
    l2 = F.radians(lon) + F.atan2(F.sin(b) * F.sin(r) * F.cos(p), F.cos(r) - F.sin(p) * F.sin(p2))
    return F.degrees(p2), F.degrees(l2)


def folded(items: Column, start: Column, step: Callable[[Column, Column], Column], kind: str, block: int = 256) -> Column:
    """The states (of type kind) after each item: step takes the state before it and the item.

    States are gathered block by block, as an array is copied whenever one is appended; items is a column, since it is named more than once.
    """
    none = F.array().cast(f"array<{kind}>")
    named = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))

    def one(acc: Column, item: Column) -> Column:
        return named(step(acc["state"], item), lambda new: F.struct(new.alias("state"), F.concat(acc["out"], F.array(new)).alias("out")))

    def part(acc: Column, i: Column) -> Column:
        inner = F.aggregate(F.slice(items, i * block + 1, F.lit(block)), F.struct(acc["state"].alias("state"), none.alias("out")), one)
        return named(inner, lambda x: F.struct(x["state"].alias("state"), F.concat(acc["out"], F.array(x["out"])).alias("out")))

    begin = F.struct(start.cast(kind).alias("state"), F.array().cast(f"array<array<{kind}>>").alias("out"))
    parts = F.sequence(F.lit(0), F.floor((F.size(items) - 1) / block).cast("int"))
    return F.when(F.size(items) > 0, F.aggregate(parts, begin, part, lambda acc: F.flatten(acc["out"]))).otherwise(none)


def hms(seconds: Column) -> Column:
    """hh:mm:ss; hours may pass 24. Null stays null."""
    s = F.floor(seconds).cast("long")
    return F.when(s.isNotNull(), F.format_string("%02d:%02d:%02d", F.expr("1") * F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60))


def rounded(c: Column, digits: int, half_even: bool = False) -> Column:
    return F.bround(c, digits) if half_even else F.round(c, digits)


def bucket(c: Column, upper: list[float], labels: list[str], low: float | None = None, low_included: bool = False) -> Column:
    """Right-closed bins: the first whose upper edge isn't below the value; beyond the last edge, the last label."""
    out = F.when(F.lit(False), F.lit(""))
    if low is not None:
        out = F.when(c < low if low_included else c <= low, F.lit(None).cast("string"))
    for u, name in zip(upper, labels):
        out = out.when(c <= u, name)
    return out.when(c.isNotNull(), labels[len(upper)]) if len(labels) > len(upper) else out


TEMP_EDGES, TEMP_LABELS = [28, 32, 35, 40], ["<28", "28-32", "32-35", "35-40", ">40"]
DT_EDGES, DT_LABELS = [2, 5, 8], ["<2", "2-5", "5-8", ">8"]
DV_EDGES, DV_LABELS = [10, 20, 30], ["0-10", "10-20", "20-30", ">30"]
SOC_EDGES, SOC_LABELS = [10, 20, 30, 40, 50, 60, 70, 80, 90], [f"{a}-{a + 10}" for a in range(0, 100, 10)]
