"""Greedy covers: from a row on until every item was seen, then anew from the next row.

A vehicle's series is cut into chunks of time, and chunks are worked on by themselves:

1. The first place of each item in each chunk gives, for every chunk, where an item comes next behind it.
2. In a chunk, each row has a link to the row that ends a cover begun there (items seen next, in the chunk or behind it),
   and following links to the chunk's end gives the cover that leaves the chunk. Covers begun at different rows soon
   end together, so that a chunk has few of these; runs of rows with one way out are a row each.
3. Those runs, a small table, are followed from chunk to chunk for each vehicle: where its covers enter each chunk.
4. Each chunk gives out the covers that begin in it.

Only step 3 takes a vehicle as a whole, and passes its runs by in order, without holding them.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.operators.joins import beside
from fleetlens.operators.timeseries import ID, SEQ, T
from fleetlens.sources.shared import ship_package, written_once

NEVER = 1 << 62
CHUNK_SEC = 86_400


def numbered(df: DataFrame, keep: dict[str, Column], chunk_sec: int = CHUNK_SEC) -> DataFrame:
    """(id, chunk, t_sec, rank, keep...): rank counts a vehicle's rows from 0, chunk by chunk."""
    rows = df.select(ID, T, SEQ, F.floor(F.col(T) / chunk_sec).alias("chunk"), *(c.alias(n) for n, c in keep.items()))
    inside = Window.partitionBy(ID, "chunk").orderBy(T, SEQ)
    before = Window.partitionBy(ID).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offset = rows.groupBy(ID, "chunk").agg(F.count("*").alias("n")).select(ID, "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    rows = rows.withColumn("__within", F.row_number().over(inside) - 1)
    return beside(rows, offset, [ID, "chunk"]).select(ID, "chunk", T, (F.col("__before") + F.col("__within")).alias("rank"), *keep)


def _next_places(rows: DataFrame, items: int) -> DataFrame:
    """(id, chunk, places): for each item, its first row behind the chunk."""
    firsts = rows.select(ID, "chunk", "rank", T, F.explode("items").alias("item")).groupBy(ID, "chunk", "item").agg(F.min("rank").alias("rank"), F.min_by(T, "rank").alias(T))
    grid = rows.select(ID, "chunk").distinct().withColumn("item", F.explode(F.sequence(F.lit(0), F.lit(items - 1))))
    behind = Window.partitionBy(ID, "item").orderBy(F.desc("chunk")).rowsBetween(Window.unboundedPreceding, -1)
    grid = beside(grid, firsts, [ID, "chunk", "item"], "left")
    grid = grid.withColumn("next", F.last(F.when(F.col("rank").isNotNull(), F.struct("rank", T)), True).over(behind))
    places = F.transform(F.sort_array(F.collect_list(F.struct("item", F.col("next.rank").alias("rank"), F.col("next.t_sec").alias("at")))), lambda x: F.struct(x["rank"], x["at"]))
    return grid.groupBy(ID, "chunk").agg(places.alias("places"))


def _chunks(batches: Iterator[pa.RecordBatch], rows: int = 65_536) -> Iterator[pa.Table]:
    """Whole chunks, some `rows` rows at once, of batches sorted by vehicle, chunk and rank; each chunk begins with its head, of rank -1."""
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        if n >= rows and len(heads := np.flatnonzero(b.column("rank").to_numpy() == -1)):
            yield pa.Table.from_batches([*held, b.slice(0, heads[0])]).combine_chunks()
            held, n, b = [], 0, b.slice(heads[0])
        held.append(b)
        n += len(b)
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


class _Links(NamedTuple):
    """Of some chunks: their heads, where each begins and stops among the rows, and for each row its chunk, rank, time, and rank and time of the row that ends a cover begun there."""

    heads: pa.Table
    begin: np.ndarray
    stop: np.ndarray
    chunk: np.ndarray
    rank: np.ndarray
    time: np.ndarray
    end: np.ndarray
    until: np.ndarray


def _links(table: pa.Table, items: int) -> _Links:
    head = table["rank"].to_numpy() == -1
    heads, rows = table.filter(pa.array(head)), table.filter(pa.array(~head))
    chunk = np.cumsum(head)[~head] - 1
    size = np.bincount(chunk, minlength=len(heads))
    stop = np.cumsum(size)
    places = heads["places"].combine_chunks().flatten().flatten()
    behind_rank, behind_time = (pc.fill_null(x, NEVER).to_numpy().reshape(len(heads), items) for x in places)
    rank, time, m = rows["rank"].to_numpy(), rows[T].to_numpy(), len(rows)
    lists = rows["items"].combine_chunks()
    item, at = lists.flatten().to_numpy(), pc.list_parent_indices(lists).to_numpy()
    order = np.argsort(item, kind="stable")
    bounds, at = np.searchsorted(item[order], np.arange(items + 1)), at[order]
    end, until = np.full(m, -1), np.full(m, -1)
    for i in range(items):
        # places ascend from chunk to chunk, so that one running minimum serves all
        has = at[bounds[i] : bounds[i + 1]]
        place = np.full(m, m)
        place[has] = has
        place = np.minimum.accumulate(place[::-1])[::-1]
        here = place < stop[chunk]
        place = np.where(here, place, 0)
        r = np.where(here, rank[place], behind_rank[chunk, i])
        later = r > end
        end[later] = r[later]
        until[later] = np.where(here, time[place], behind_time[chunk, i])[later]
    return _Links(heads, stop - size, stop, chunk, rank, time, end, until)


def covers(df: DataFrame, items: Column, n: int, keep: dict[str, Column] | None = None, chunk_sec: int = CHUNK_SEC) -> tuple[DataFrame, DataFrame]:
    """(covers, rows). covers: (id, cycle, start, end, rows, since, first, last); since is the time from the cover before, first and last are ranks.

    items: an array of numbers; those from 0 to n - 1 count. rows: as `numbered`, with items and keep.
    """
    ship_package(df.sparkSession)
    inside = F.filter(F.coalesce(items, F.array().cast("array<int>")), lambda i: i.isNotNull() & (i >= 0) & (i < n))
    rows = written_once(numbered(df, {"items": inside.cast("array<int>"), **(keep or {})}, chunk_sec), "rows")
    slim = rows.select(ID, "chunk", T, "rank", "items")
    heads = written_once(_next_places(rows, n), "places")

    def by_chunk(heads: DataFrame) -> DataFrame:
        """Each chunk's head, then its rows in order."""
        both = slim.unionByName(heads.withColumn("rank", F.lit(-1).cast("long")), allowMissingColumns=True)
        return both.repartition(ID, "chunk").sortWithinPartitions(ID, "chunk", "rank")

    def ways_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _chunks(batches):
            k = _links(table, n)
            leaves = k.end >= k.rank[k.stop - 1][k.chunk]
            here = np.arange(len(k.rank))
            goal = np.where(leaves, here, here + k.end + 1 - k.rank)
            while (goal[goal] != goal).any():
                goal = goal[goal]
            out = k.end != NEVER
            exits, at = (np.where(out, x, -1)[goal] for x in (k.end, k.until))
            last = np.flatnonzero(np.append((exits[1:] != exits[:-1]) | (k.chunk[1:] != k.chunk[:-1]), True))
            heads = k.heads.select([ID, "chunk"]).take(k.chunk[last])
            yield from pa.table([*heads.columns, pa.array(k.rank[last]), pa.array(exits[last]), pa.array(at[last])], [ID, "chunk", "upto", "exit", "at"]).to_batches()

    runs = by_chunk(heads).mapInArrow(ways_out, f"{ID} string, chunk long, upto long, exit long, at long")

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of a vehicle come in order; the first that isn't before the entry holds it, and its exit gives the next one."""
        vehicle: object = ...
        for b in batches:
            out = []
            for v, chunk, upto, leaves, at in zip(*(b.column(c).to_pylist() for c in (ID, "chunk", "upto", "exit", "at"))):
                if v != vehicle:
                    vehicle, entry, before = v, 0, None
                if upto >= entry:
                    out.append((v, chunk, entry, before))
                    entry, before = (NEVER, None) if leaves < 0 else (leaves + 1, at)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.string(), pa.int64(), pa.int64(), pa.int64()))], [ID, "chunk", "entry", "before"])

    entered = runs.repartition(ID).sortWithinPartitions(ID, "upto").mapInArrow(entries, f"{ID} string, chunk long, entry long, before long")

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _chunks(batches):
            k = _links(table, n)
            rank, time, end, until = (x.tolist() for x in (k.rank, k.time, k.end, k.until))
            out = []
            for c, (entry, before, begin, stop) in enumerate(zip(k.heads["entry"].to_pylist(), k.heads["before"].to_pylist(), k.begin.tolist(), k.stop.tolist())):
                i = stop if entry is None else begin + entry - rank[begin]
                while i < stop and end[i] != NEVER:
                    rows = end[i] - rank[i] + 1
                    out.append((c, time[i], until[i], rows, None if before is None else time[i] - before, rank[i], end[i]))
                    before, i = until[i], i + rows
            if out:
                at, *columns = (pa.array(c, pa.int64()) for c in zip(*out))
                yield from pa.table([k.heads[ID].take(at), *columns], [ID, "start", "end", "rows", "since", "first", "last"]).to_batches()

    asked = beside(heads, entered, [ID, "chunk"], "left")
    found = by_chunk(asked).mapInArrow(replay, f"{ID} string, start long, end long, rows long, since long, first long, last long")
    cycle = F.row_number().over(Window.partitionBy(ID).orderBy("first")).cast("long")
    return found.select(ID, cycle.alias("cycle"), "start", "end", "rows", "since", "first", "last"), rows
