"""Words of a column of texts, cut by Arrow. Used inside Spark tasks."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def tidy() -> None:
    """Gives memory that Arrow and numpy have freed back to the system: a worker that waits for its next task, beside others at work, then holds little."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def translated(texts: pa.Array, table: np.ndarray) -> pa.Array:
    """texts with each byte replaced by table's entry for it; nulls become empty. The table keeps ASCII within ASCII and other bytes as they are."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    _, bounds, data = texts.buffers()
    at = np.frombuffer(bounds, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data else np.zeros(0, np.uint8)
    return pa.Array.from_buffers(pa.large_utf8(), len(texts), [None, pa.py_buffer(np.ascontiguousarray(at - at[0])), pa.py_buffer(table[raw])])


def byte_table(lower: bool = True, words: str | None = None) -> np.ndarray:
    """For translated: A-Z lower-cased; with words, every ASCII character that isn't one of them becomes a blank."""
    table = np.arange(256, dtype=np.uint8)
    if words is not None:
        table[:128] = ord(" ")
        at = np.frombuffer(words.encode("ascii"), np.uint8)
        table[at] = at
    if lower:
        table[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
    return table


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(the words of all texts one after the other, how many each text has); words are runs without blanks, tabs and line ends.

    texts holds no nulls.
    """
    lists = pc.ascii_split_whitespace(texts)
    words, ends = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    ends = ends - ends[0]
    # blanks at the edges of a text leave empty words there
    full = pc.not_equal(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    upto = np.concatenate([[0], np.cumsum(full)])[ends]
    return words if full.all() else words.filter(pa.array(full)), np.diff(upto)


def slices(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[pa.Array, pa.Array]]:
    """(first column, second column) of rows whose texts, in the second column, have about `most` bytes together; one text may have more."""
    held: list[tuple[pa.Array, pa.Array]] = []
    size = 0
    for b in batches:
        ids, texts = b.column(0), b.column(1)
        ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
        row = 0
        while row < len(ends):
            # up to the text that makes it full
            done = int(ends[row - 1]) if row else 0
            stop = min(len(ends), int(np.searchsorted(ends, done + most - size)) + 1)
            held.append((ids.slice(row, stop - row), texts.slice(row, stop - row)))
            size += int(ends[stop - 1]) - done
            row = stop
            if size >= most:
                full, held, size = tuple(pa.concat_arrays(x) for x in zip(*held)), [], 0
                yield full
                del full
                tidy()
    if held:
        yield tuple(pa.concat_arrays(x) for x in zip(*held))
    held = []
    tidy()


def joined(words: pa.Array, ends: np.ndarray) -> pa.Array:
    """Texts of words[ends[i]:ends[i + 1]], with one blank between words."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), words), pa.scalar(" ", words.type))
