"""Signal dictionaries, the search for a signal's bytes, sweeps by segment, and the fleet view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.operators.covers import CHUNK_SEC, covers
from fleetlens.operators.joins import beside
from fleetlens.operators.timeseries import ID


def _plain(name: Column) -> Column:
    """A name's parts between underscores, in lower case; empty parts don't count."""
    return F.array_join(F.filter(F.split(F.lower(name), "_"), lambda part: part != ""), "_")


def signal_of(line: Column) -> Column:
    """(signal, lo, hi) of a signal's line in a dictionary, nulls for other lines.

    Such a line is `SG_ name : layout (factor,offset) [lo|hi] "unit" receivers`; a mark of multiplexing may follow the
    name, and all between the colon and the bracket may lack.
    """
    text = F.trim(line)
    head = F.substring_index(text, ":", 1)
    bracket = F.substring_index(F.substring_index(F.substring(text, F.length(head) + 2, F.length(text)), "]", 1), "[", -1)
    name = F.when(F.startswith(text, F.lit("SG_ ")) & F.contains(text, F.lit(":")), F.get(F.split(F.trim(F.substring(head, 4, 2**31 - 1)), " +"), F.lit(0)))
    bound = lambda i: F.when(name.isNotNull() & F.contains(bracket, F.lit("|")), F.trim(F.substring_index(bracket, "|", i)).try_cast("double"))
    return F.struct(name.alias("signal"), bound(1).alias("lo"), bound(-1).alias("hi"))


def ranges_of_lines(lines: DataFrame, line: str = "value", at: str = "n") -> DataFrame:
    """(signal, lo, hi) of a dictionary's signals with a range; of lines with one name the last counts."""
    found = lines.select(signal_of(F.col(line)).alias("s"), at).where("s.signal IS NOT NULL AND s.lo IS NOT NULL AND s.hi IS NOT NULL")
    found = found.select(_plain(F.col("s.signal")).alias("signal"), F.struct("s.lo", "s.hi").alias("range"), at)
    return found.groupBy("signal").agg(F.max_by("range", at).alias("range")).select("signal", "range.lo", "range.hi")


def expected_ranges(columns: DataFrame, ranges: DataFrame, families: list[tuple[str, float, float]]) -> DataFrame:
    """(column, lo, hi): the dictionary's range, else that of the first family whose pattern the name matches, else nulls."""
    name = _plain(F.col("column"))
    family = F.lit(None).cast("struct<lo:double,hi:double>")
    for pattern, lo, hi in reversed(families):
        family = F.when(name.rlike(pattern), F.struct(F.lit(lo).cast("double").alias("lo"), F.lit(hi).cast("double").alias("hi"))).otherwise(family)
    known = F.when(F.col("signal").isNotNull(), F.struct("lo", "hi")).otherwise(family)
    return columns.join(ranges, name == F.col("signal"), "left").select("column", known.alias("range")).select("column", "range.lo", "range.hi")


def signal_byte_search(frames: DataFrame, values: DataFrame, tolerance_ms: int = 20, scale: int = 1000) -> DataFrame:
    """(id, name, can_id, position, endian, hits): the two bytes of a frame that carry a parsed value at about its time.

    frames: id, sequence, ts_ms, can_id, bytes; values: id, name, ts_ms, value. The first hit counts (earliest value, then
    frame, then position, little before big). Null and zero values say nothing. An equi-join on the raw number and a time
    bucket: a frame lies in one bucket, a value in at most two.
    """
    width = 2 * tolerance_ms + 1
    b = F.col("bytes")

    def at(i: Column) -> Column:
        low, high = F.get(b, i).cast("long"), F.get(b, i + 1).cast("long")
        one = lambda e, raw: F.struct(i.alias("position"), F.lit(e).alias("big"), raw.alias("raw"))
        return F.array(one(0, low + 256 * high), one(1, 256 * low + high))

    pairs = frames.where(F.size("bytes") > 1).withColumn("p", F.explode(F.flatten(F.transform(F.sequence(F.lit(0), F.size("bytes") - 2), at))))
    pairs = pairs.select("id", "sequence", F.col("ts_ms").alias("frame_ms"), "can_id", "p.*", F.floor(F.col("ts_ms") / width).alias("bucket")).where("raw > 0")
    ends = F.array_distinct(F.array(*(F.floor((F.col("ts_ms") + d) / width) for d in (-tolerance_ms, tolerance_ms))))
    wanted = values.select("id", "name", "ts_ms", F.round(F.col("value") * scale).cast("long").alias("raw"), F.explode(ends).alias("bucket")).where("raw > 0")
    hits = wanted.join(pairs, ["id", "raw", "bucket"]).where(F.abs(F.col("frame_ms") - F.col("ts_ms")) <= tolerance_ms)
    first = F.min_by(F.struct("can_id", "position", "big"), F.struct("ts_ms", "frame_ms", "sequence", "position", "big"))
    found = hits.groupBy("id", "name").agg(first.alias("f"), F.count("*").alias("hits"))
    return found.select("id", "name", "f.can_id", "f.position", F.when(F.col("f.big") == 1, "BE").otherwise("LE").alias("endian"), "hits")


def segment_sweeps(df: DataFrame, segments: int, group: int = 8, sensors: str = "sensors", chunk_sec: int = CHUNK_SEC) -> DataFrame:
    """(id, cycle, start, end, since, counts): from the first row with a sensor until each segment of `group` sensors has reported, then anew.

    sensors: array of the sensor numbers (from 1) that a row holds. counts: rows in which each segment reported.
    """
    number = F.filter(F.col(sensors), lambda s: s.isNotNull() & (s > 0) & (s <= segments * group))
    seen = F.array_distinct(F.transform(number, lambda s: F.floor((s - 1) / group).cast("int")))
    found, rows = covers(df.where(F.size(seen) > 0), seen, segments, chunk_sec=chunk_sec)
    # a row meets its cover by rank: equal blocks of ranks first, then the range
    block = lambda c: F.floor(F.col(c) / 4096)
    spans = found.select(ID, "cycle", "start", "end", "since", "first", "last", F.explode(F.sequence(block("first"), block("last"))).alias("block"))
    within = beside(rows.select(ID, "rank", block("rank").alias("block"), "items"), spans, [ID, "block"]).where(F.col("rank").between(F.col("first"), F.col("last")))
    cover = [ID, "cycle", "start", "end", "since"]
    # every cover has rows of each segment, so that none is lost here
    counts = within.select(*cover, F.explode("items").alias("segment")).groupBy(*cover, "segment").agg(F.count("*").alias("n"))
    return counts.groupBy(*cover).agg(F.transform(F.sort_array(F.collect_list(F.struct("segment", "n"))), lambda x: x["n"]).alias("counts"))


def fleet_filter_view(vehicles: DataFrame, device_map: DataFrame, devices: DataFrame, operator_map: DataFrame, organizations: DataFrame, route_map: DataFrame, routes: DataFrame, cities: DataFrame, now: Column) -> DataFrame:
    """Vehicles beside their devices, operators and routes (all left joins), and whether a device is in use at `now`.

    vehicles: vehicle_id, fleet_id, ...; device_map: vehicle_id, mapped_device, installed, uninstalled; devices: device_id,
    vendor_device_id, device_status, ...; operator_map: fleet_id, mapped_operator, ...; organizations: operator_id, ...;
    route_map: vehicle_id, mapped_route, ...; routes: route_id, start_city_id, end_city_id; cities: city_id, city_name.
    Catalyst picks the joins by the tables' sizes.
    """
    city = lambda end: cities.select(F.col("city_id").alias(f"__{end}"), F.col("city_name").alias(f"{end}_city_name"))
    joined = (
        vehicles.join(device_map, "vehicle_id", "left")
        .join(devices, F.col("mapped_device") == F.col("device_id"), "left")
        .join(operator_map, "fleet_id", "left")
        .join(organizations, F.col("mapped_operator") == F.col("operator_id"), "left")
        .join(route_map, "vehicle_id", "left")
        .join(routes, F.col("mapped_route") == F.col("route_id"), "left")
        .join(city("start"), F.col("start_city_id") == F.col("__start"), "left")
        .join(city("end"), F.col("end_city_id") == F.col("__end"), "left")
    )
    in_use = F.col("device_id").isNotNull() & F.col("vendor_device_id").isNotNull() & (F.col("device_status") == "ACTIVE") & (F.col("installed") <= now) & F.col("uninstalled").isNull()
    return joined.withColumn("is_current_active_device", F.coalesce(in_use, F.lit(False))).drop("mapped_device", "mapped_operator", "mapped_route", "__start", "__end")
