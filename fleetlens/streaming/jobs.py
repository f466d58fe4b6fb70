"""The alert, mileage and sweep jobs, run continuously with Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from fleetlens.operators.buckets import mileage_totals
from fleetlens.sources.shared import ship_package


def stream_alert_periods(df: DataFrame, alert: Column, apart: str = "2 minutes", late: str = "10 minutes", min_sec: int = 300) -> DataFrame:
    """Alert rows at most `apart` from each other form a period; it is given out when the watermark has passed it."""
    # a predicate that reads ts stays above the watermark, so that quiet rows move it on
    now = F.when(F.col("ts").isNotNull(), alert)
    periods = df.withWatermark("ts", late).where(now).groupBy("id", F.session_window("ts", apart)).agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count("*").alias("rows"))
    return periods.where(F.unix_seconds("end") - F.unix_seconds("start") >= min_sec).select("id", "start", "end", "rows")


def stream_mode_sessions(df: DataFrame, max_gap_sec: int = 300, late: str = "10 minutes") -> DataFrame:
    """Sessions of one mode. State of a vehicle is its open session; rows come in order within the watermark's lateness.

    df: id, ts, mode. A session closes on another mode or a longer gap, or when event time has passed the gap.
    """

    def one(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        held = state.get if state.exists else None
        if state.hasTimedOut:
            out.append((key[0], *held))
            state.remove()
        else:
            rows = pd.concat(list(batches)).sort_values("ts")
            for ts, mode in zip(rows["ts"].astype("int64") // 10 ** (9 if rows["ts"].dtype == "datetime64[ns]" else 6), rows["mode"]):
                if held and (mode != held[0] or ts - held[2] > max_gap_sec):
                    out.append((key[0], *held))
                    held = None
                held = (mode, min(held[1], ts), max(held[2], ts), held[3] + 1) if held else (mode, int(ts), int(ts), 1)
            state.update(held)
            state.setTimeoutTimestamp(max((held[2] + max_gap_sec) * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["id", "mode", "start", "end", "rows"])

    return (
        df.withWatermark("ts", late)
        .groupBy("id")
        .applyInPandasWithState(one, "id string, mode string, start long, end long, rows long", "mode string, start long, end long, rows long", "append", GroupStateTimeout.EventTimeTimeout)
    )


class StepProcessor(StatefulProcessor):
    """The steps of each sample, as the vehicle's sample before it gives them, whatever order samples arrive in.

    A key is a bucket of vehicles, as a call for every vehicle costs more than its samples do. State of a bucket, as Arrow
    batches: the last sample of each vehicle that was given out, and the samples that the watermark hasn't reached. A timer
    stands at the earliest of these; when the watermark reaches it, samples up to the watermark leave in their order.
    """

    HELD = "ts timestamp, t_sec long, sequence long, odo double, speed double, volts double, amps double"
    OUT = f"id string, {HELD}, step_sec long, step_km double, step_speed double"
    NUMBERS = {"t_sec": pa.int64(), "sequence": pa.int64(), "odo": pa.float64(), "speed": pa.float64(), "volts": pa.float64(), "amps": pa.float64()}
    ROWS = pa.schema({"id": pa.string(), "ts": pa.timestamp("us"), **NUMBERS})
    LAST = pa.schema({"id": pa.string(), "t_sec": pa.int64(), "odo": pa.float64(), "speed": pa.float64()})

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "batch binary")
        self.held = handle.getListState("held", "batch binary")

    def wait_for(self, earliest: int | None) -> None:
        """One timer at a time, in milliseconds."""
        timers = list(self.handle.listTimers())
        for t in timers:
            if t != earliest:
                self.handle.deleteTimer(t)
        if earliest is not None and earliest not in timers:
            self.handle.registerTimer(earliest)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        new = pa.concat_tables(pa.Table.from_pandas(b[self.ROWS.names], self.ROWS, preserve_index=False, safe=False) for b in rows)
        self.held.appendValue((_packed(new),))
        self.wait_for(min([int(_millis(new).min()), *self.handle.listTimers()]))
        return iter([])

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        rows = pa.concat_tables(_unpacked(blob) for (blob,) in self.held.get())
        due = _millis(rows) <= timerValues.getCurrentWatermarkInMs()
        ready, rest = rows.filter(pa.array(due)), rows.filter(pa.array(~due))
        if len(ready):
            last = _unpacked(self.last.get()[0]) if self.last.exists() else self.LAST.empty_table()
            out, last = self.steps(last, ready)
            self.last.update((_packed(last),))
            self.held.clear()
            if len(rest):
                self.held.appendValue((_packed(rest),))
        self.wait_for(int(_millis(rest).min()) if len(rest) else None)
        if len(ready):
            yield out.to_pandas()

    def steps(self, last: pa.Table, ready: pa.Table) -> tuple[pa.Table, pa.Table]:
        """Samples with their steps, and the last sample of each vehicle behind them. A vehicle's carried sample stands before its new ones."""
        rows = pa.concat_tables([last, ready], promote_options="default")
        vehicle = pc.dictionary_encode(rows["id"].combine_chunks(), null_encoding="encode").indices.to_numpy()
        first = np.iinfo(np.int64).min
        order = np.lexsort([*(pc.fill_null(rows[c], first).to_numpy() for c in ("sequence", "t_sec")), np.arange(len(rows)) >= len(last), vehicle])
        rows, vehicle, new = rows.take(order), vehicle[order], order >= len(last)
        same = vehicle[1:] == vehicle[:-1]
        at = pa.array(np.arange(-1, len(rows) - 1), mask=np.append(True, ~same))
        since = {c: pc.subtract(rows[c], rows[c].take(at)) for c in ("t_sec", "odo", "speed")}
        out = rows.select(self.ROWS.names).append_column("step_sec", pc.fill_null(since["t_sec"], 0))
        out = out.append_column("step_km", pc.max_element_wise(since["odo"], 0.0)).append_column("step_speed", since["speed"])
        return out.filter(pa.array(new)), rows.select(self.LAST.names).filter(pa.array(np.append(~same, True)))

    def close(self) -> None:
        pass


def _millis(rows: pa.Table) -> np.ndarray:
    return rows["ts"].cast(pa.int64()).to_numpy() // 1000


def _packed(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as out:
        out.write_table(rows)
    return sink.getvalue().to_pybytes()


def _unpacked(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(blob).read_all()


def stream_mileage_15min(df: DataFrame, late: str = "10 minutes", period_sec: int = 900, least_km: float = 0.01, dt_cap: float = 300, regen: float = 0.8, buckets: int = 256) -> DataFrame:
    """(id, period, km, used_kwh, regen_kwh, idle_kwh, ...) of each vehicle and quarter of an hour, as mileage_energy gives it for the whole table.

    df: id, ts, t_sec, sequence, odo, speed, volts, amps; rows come in any order within the lateness. Two stateful operators in a
    chain: steps between a vehicle's samples, then tumbling windows over them, which close in the batch whose watermark
    passes their end. A task takes a bucket's samples of a batch at once; a checkpoint stays with its number of buckets. The session must keep state in RocksDB (spark.sql.streaming.stateStore.providerClass) and its time
    zone at UTC.
    """
    ship_package(df.sparkSession)
    rows = df.select("id", "ts", "t_sec", "sequence", "odo", "speed", "volts", "amps").withWatermark("ts", late)
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(buckets)))
    steps = rows.groupBy("bucket").transformWithStateInPandas(StepProcessor(), StepProcessor.OUT, "Append", "EventTime", eventTimeColumnName="ts")
    out = mileage_totals(steps, ["id", F.window("ts", f"{period_sec} seconds").alias("w")], period_sec, least_km, dt_cap, regen)
    return out.withColumn("period", F.unix_seconds("w.start")).drop("w")


def stream_sweep_cycles(df: DataFrame, sensors: int, sensor: str = "sensor") -> DataFrame:
    """Sweeps over all sensors of a vehicle; its state is the set of sensors seen, the open sweep and the last one's end.

    df: id, ts, sensor (null: none). Rows count in the order in which batches bring them, by time within a batch.
    """

    def one(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen_text, start, rows, cycle, before = state.get if state.exists else ("", None, 0, 0, None)
        seen = {int(s) for s in seen_text.split(",") if s}
        out: list[tuple] = []
        held = pd.concat(list(batches)).sort_values("t", kind="stable")
        for t, s in zip(held["t"].tolist(), held["sensor"]):
            start = t if start is None else start
            rows += 1
            if s is not None and s == s:
                seen.add(int(s))
            if len(seen) == sensors:
                cycle += 1
                out.append((key[0], cycle, start, t, rows, None if before is None else start - before))
                seen, start, rows, before = set(), None, 0, t
        state.update((",".join(map(str, sorted(seen))), start, rows, cycle, before))
        yield pd.DataFrame(out, columns=["id", "cycle", "start", "end", "rows", "since"]).astype({"since": "Int64"})

    return (
        df.select("id", F.unix_seconds("ts").alias("t"), F.col(sensor).cast("long").alias("sensor"))
        .groupBy("id")
        .applyInPandasWithState(one, "id string, cycle long, start long, end long, rows long, since long", "seen string, start long, rows long, cycle long, before long", "append", GroupStateTimeout.NoTimeout)
    )
