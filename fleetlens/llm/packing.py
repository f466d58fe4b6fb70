"""Packing token sequences by the sum-of-squares rule.

A document of more tokens than a window holds gives full windows first; what is left is placed online: of the fill
levels that have room, it goes to the one that leaves the smallest sum of squared counts of partly filled windows. The
counts lie in one array by level, so a choice costs one vector operation, however many windows are open.

Each task packs its own rows as they are encoded, in one narrow stage: no shuffle, and only the open windows are held.
When a task's rows end, its open windows are poured together (pieces may be cut), so that each task leaves at most one
window with padding.

Null and empty texts are one piece, the end token alone. Repeated ids give pieces for each row. Sequence ids are the
task's number times 2^40 plus a count, so they don't depend on which executor runs a task, or how often.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from fleetlens.llm.bpe import map_encoded

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long"
#: (doc_id, start, ids, doc_tokens)
Piece = tuple[int, int, np.ndarray, int]


class LevelArray:
    """Open windows by fill level."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.count = np.zeros(capacity + 1, np.int64)
        self.open: list[list[list[Piece]]] = [[] for _ in range(capacity)]

    def choose(self, size: int) -> int:
        """The level (0: a new window) that makes the sum of squared counts smallest; ties go to the fullest."""
        n = self.count
        room = self.capacity - size
        # a window moves from level h to h + size; new and full windows don't count
        change = 2 * n[size : size + room + 1] + 1
        change[room] = 0
        change[1:] += np.where(n[1 : room + 1] > 0, 1 - 2 * n[1 : room + 1], 4 * n.sum() + 4)
        return room - int(np.argmin(change[::-1]))

    def place(self, piece: Piece) -> list[Piece] | None:
        """The window, if this piece fills it."""
        size = len(piece[2])
        h = self.choose(size)
        window = self.open[h].pop() if h else []
        self.count[h] -= bool(h)
        window.append(piece)
        if h + size == self.capacity:
            return window
        self.open[h + size].append(window)
        self.count[h + size] += 1
        return None

    def poured(self) -> Iterator[list[Piece]]:
        """Empties the open windows into full ones and at most one other, fullest first, cutting where need be."""
        pieces = [p for level in reversed(self.open) for window in level for p in window]
        window, used = [], 0
        for doc, start, ids, total in pieces:
            while len(ids):
                part = ids[: self.capacity - used]
                window.append((doc, start, part, total))
                used, start, ids = used + len(part), start + len(part), ids[len(part) :]
                if used == self.capacity:
                    yield window
                    window, used = [], 0
        if window:
            yield window


def packed(pieces: Iterator[Piece], capacity: int, first: int) -> Iterator[tuple]:
    """Rows of SCHEMA; pieces are whole documents."""
    levels, sequence = LevelArray(capacity), first

    def rows(window: list[Piece]) -> Iterator[tuple]:
        nonlocal sequence
        offset, fill = 0, sum(len(p[2]) for p in window)
        for doc, start, ids, total in window:
            yield doc, start, len(ids), zlib.crc32(ids.tobytes()), total, sequence, offset, fill
            offset += len(ids)
        sequence += 1

    for doc, _, ids, total in pieces:
        whole = len(ids) // capacity * capacity
        for start in range(0, whole, capacity):
            yield from rows([(doc, start, ids[start : start + capacity], total)])
        if whole < len(ids):
            full = levels.place((doc, whole, ids[whole:].copy(), total))
            if full:
                yield from rows(full)
    for window in levels.poured():
        yield from rows(window)


def pack(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents, in windows of capacity tokens; each document is its tokens, then end_id."""

    def task(slices) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], "<u4")

        def whole() -> Iterator[Piece]:
            for batch, row, ids, ends in slices:
                names = batch.column("doc_id").slice(row, len(ends) - 1).to_pylist()
                for doc, a, b in zip(names, ends[:-1].tolist(), ends[1:].tolist()):
                    yield doc, 0, np.concatenate([ids[a:b], end]), b - a + 1

        out: list[tuple] = []
        schema = pa.schema([(f.split()[0], pa.int64()) for f in SCHEMA.split(", ")])
        for r in packed(whole(), capacity, TaskContext.get().partitionId() << 40):
            out.append(r)
            if len(out) == 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], schema=schema)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], schema=schema)

    return map_encoded(docs, path, SCHEMA, task, id_col, text_col)
