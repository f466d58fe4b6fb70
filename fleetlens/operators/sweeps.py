"""Raw bus frames, sensor sweeps, and steps in which a sample depends on what became of those before."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.operators.covers import CHUNK_SEC, covers
from fleetlens.operators.signals import signal_of
from fleetlens.operators.timeseries import ID, SEQ, T, from_here, series, up_to_here

#: Time, channel, id, direction, kind, length, then as many bytes.
FRAME_LINE = r"^\s*([0-9]+\.[0-9]+)\s+\S+\s+([0-9A-Fa-f]+)x?\s+\S+\s+\S+\s+[0-9]+((?:\s+[0-9A-Fa-f]{2}){1,8})(?:\s|$)"


def frames_of_text(lines: DataFrame, base_ms: int, line: str = "value") -> DataFrame:
    """(ts_ms, can_id, bytes) from the lines of a bus log that hold a frame; bytes that a shorter frame lacks are 0."""
    part = lambda i: F.regexp_extract(line, FRAME_LINE, i)
    found = lines.where(F.col(line).rlike(FRAME_LINE))
    number = F.transform(F.split(F.trim(part(3)), r"\s+"), lambda b: F.conv(b, 16, 10).cast("int"))
    full = F.slice(F.concat(number, F.array_repeat(F.lit(0), 8)), 1, 8)
    return found.select((F.lit(base_ms) + F.round(part(1).cast("double") * 1000).cast("long")).alias("ts_ms"), F.conv(part(2), 16, 10).cast("long").alias("can_id"), full.alias("bytes"))


def frame_lines(frames: DataFrame, base_ms: int, places: list[int] | None = None) -> DataFrame:
    """frames and `value`, the log line of each. places: where in `bytes` (from 0) the first, second, ... byte of the line stands."""
    data = F.array(*(F.get("bytes", F.lit(i)) for i in places)) if places else F.col("bytes")
    hexes = F.array_join(F.transform(data, lambda b: F.lower(F.lpad(F.hex(b), 2, "0"))), " ")
    return frames.withColumn("value", F.concat(F.format_string("%.6f 1 %08xx Rx d ", (F.col("ts_ms") - base_ms) / 1000, F.col("can_id")), F.size(data).cast("string"), F.lit(" "), hexes))


def text_of_frames(frames: DataFrame, base_ms: int, places: list[int] | None = None) -> DataFrame:
    """A log's lines in order of time and sequence (where frames have one)."""
    order = [c for c in ("ts_ms", SEQ) if c in frames.columns]
    return frame_lines(frames, base_ms, places).orderBy(*order).select("value")


def write_asc_frames(frames: DataFrame, path: str, base_ms: int, places: list[int] | None = None) -> None:
    """The log as text files, whose names follow its order; the first lines of each file are the format's head."""
    head = [f"date {datetime.fromtimestamp(base_ms / 1000, timezone.utc):%a %b %d  %I:%M:%S %p %Y}", "base hex timestamps absolute"]
    lines = text_of_frames(frames, base_ms, places)

    def headed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for i, b in enumerate(batches):
            if not i:
                yield pa.RecordBatch.from_arrays([pa.array(head).cast(b.schema.field(0).type)], schema=b.schema)
            yield b

    lines.mapInArrow(headed, "value string").write.text(path)


def dbc_dictionary(lines: DataFrame, line: str = "value", at: str = "n") -> DataFrame:
    """(dbc_id, position, signal, lo, hi) from dictionary text; lines carry their number within a file."""
    frame = F.nullif(F.regexp_extract(line, r"^BO_ (\d+) ", 1), F.lit("")).try_cast("long")
    w = Window.partitionBy("file").orderBy(at)
    df = lines.withColumns({"dbc_id": F.last(frame, True).over(w.rowsBetween(Window.unboundedPreceding, 0)), "__signal": signal_of(F.col(line))}).select("*", "__signal.*").where("signal IS NOT NULL")
    return df.withColumn("position", F.row_number().over(Window.partitionBy("file", "dbc_id").orderBy(at)) - 1).select("dbc_id", "position", "signal", "lo", "hi")


def raw_id(dbc_id: Column) -> Column:
    """The id on the bus: the dictionary's without the top bit."""
    return dbc_id.bitwiseAND(F.lit(0x7FFFFFFF))


def decode_frames(frames: DataFrame, signals: DataFrame) -> DataFrame:
    """One row for each sensor in a frame. signals: (can_id, k, kind, sensor_no); temperatures are a byte less 40, voltages two bytes in mV, low byte first."""
    at = F.col("k")
    value = F.when(F.col("kind") == "temperature", F.get("bytes", at) - 40.0).otherwise((F.get("bytes", 2 * at) + 256 * F.get("bytes", 2 * at + 1)) * 0.001)
    return frames.join(signals, "can_id").select(*[c for c in frames.columns if c != "bytes"], "kind", "sensor_no", value.alias("value"))


def sweep_cycles(df: DataFrame, sensors: int, sensor: str = "sensor", chunk_sec: int = CHUNK_SEC) -> DataFrame:
    """(id, cycle, start, end, rows, since): rows until all sensors (0 to sensors - 1) were seen, then anew. Other numbers count as rows alone."""
    found, _ = covers(df, F.array(F.col(sensor).cast("int")), sensors, chunk_sec=chunk_sec)
    return found.drop("first", "last")


def micro_blip_smooth(df: DataFrame, mode: str = "mode", blip_sec: float = 60, domains: tuple[str, str] = ("CHARGING", "DISCHARGING")) -> DataFrame:
    """One sample of the other domain between two of one takes that domain's active mode; later samples see the change.

    With d the domain before a sample, as changed, such a sample keeps d, be it the sample's own or the next one's: it
    passes on what it gets. Every other sample sets its own domain. So the changed domain is that of the last sample that
    sets one: a running value instead of a walk. Modes outside both domains are left alone and stand between no blip.
    """
    domain = F.when(F.col("__d").isin(*domains), F.col("__d"))
    df = df.select(ID, T, SEQ, F.col(mode).alias("__mode"), F.split(F.col(mode), "_")[0].alias("__d")).withColumn("__d", domain)
    w = series()
    nearby = F.col(T) - F.lag(T).over(w) <= blip_sec
    passes = nearby & F.lag("__d").over(w).isNotNull() & (F.lead("__d").over(w) != F.col("__d"))
    df = df.withColumn("__sets", ~F.coalesce(passes, F.lit(False)))
    changed = F.last(F.when(F.col("__sets"), F.struct("__d")), True).over(up_to_here(w))["__d"]
    df = df.withColumn("__changed", changed)
    return df.select(ID, SEQ, F.when(~F.col("__sets") & (F.col("__changed") != F.col("__d")), F.concat("__changed", F.lit("_ACTIVE"))).otherwise(F.col("__mode")).alias("smoothed"))


def brake_to_stop(df: DataFrame, within_sec: float = 60, moving: float = 1.0, still: float = 0.1) -> DataFrame:
    """From a press while moving to the first standstill within the time; the next search begins behind it.

    Every press before a standstill leads to it or to none, so that the presses of one standstill are a group, whose
    first one within the time begins the stop; stops then don't overlap.
    """
    speed = F.when(~F.isnan("speed"), F.col("speed"))
    df = df.select(ID, T, SEQ, speed.alias("speed"), "brake")
    stop = F.last(F.when(F.col("speed") <= still, F.struct(F.col(T).alias("t"), F.col(SEQ).alias("n"))), True).over(from_here(1))
    presses = df.withColumn("__stop", stop).where((F.col("brake") > 0) & (F.col("speed") > moving) & (F.col("__stop.t") - F.col(T) <= within_sec))
    first = F.min_by(F.struct(T, "speed"), F.struct(T, SEQ))
    return presses.groupBy(ID, "__stop").agg(first.alias("f")).select(ID, F.col(f"f.{T}").alias("start"), F.col("__stop.t").alias("stop"), F.col("f.speed").alias("start_speed"))


def search_frames(frames: DataFrame, can_id: int, values: dict[int, int]) -> DataFrame:
    """Frames of one id whose bytes (numbered from 1) have the given values; shorter frames have none there."""
    cond = F.col("can_id") == can_id
    for number, value in values.items():
        cond = cond & (F.get("bytes", F.lit(number - 1)) == value)
    return frames.where(F.coalesce(cond, F.lit(False)))


def frequent_ids(frames: DataFrame, above: int, below: int) -> DataFrame:
    """(can_id, n): ids that more than `above` and fewer than `below` frames have."""
    return frames.groupBy("can_id").agg(F.count("*").alias("n")).where((F.col("n") > above) & (F.col("n") < below))


def sensor_health(long: DataFrame, low: float, high: float) -> DataFrame:
    """Per sensor: dead (no value), stuck (hardly varies), values out of range. long: (sensor_no, value)."""
    v = F.col("value")
    out = long.groupBy("sensor_no").agg(F.count(v).alias("n"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("__sd"), F.count_distinct(v).alias("__d"), F.count_if((v < low) | (v > high)).alias("out_of_range"))
    return out.select("sensor_no", "n", (F.col("n") == 0).alias("dead"), ((F.col("n") > 0) & ((F.col("__sd") < 1e-4) | (F.col("__d") <= 2))).alias("stuck"), "out_of_range")


def robust_outliers(long: DataFrame, by: list[str], limit: float = 3) -> DataFrame:
    """Values whose 0.6745 * (x - median) / MAD within their group is beyond the limit."""
    mid = long.groupBy(*by).agg(F.median("value").alias("__m"))
    dev = long.join(mid, by).withColumn("__d", F.abs(F.col("value") - F.col("__m")))
    mad = dev.groupBy(*by).agg(F.median("__d").alias("__mad"))
    z = 0.6745 * (F.col("value") - F.col("__m")) / F.nullif(F.col("__mad"), F.lit(0.0))
    return dev.join(mad, by).withColumn("z", z).where(F.abs("z") > limit).drop("__m", "__d", "__mad")
