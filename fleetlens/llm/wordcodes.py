"""Word sequences as integers, for operators that compare runs of words. Numpy helpers used inside Spark tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from fleetlens.llm.words import byte_table, slices, split, translated

#: An odd 64-bit multiplier for polynomial codes; any such number does.
BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the finaliser of splitmix64)."""
    x = x.astype(np.uint64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def run_codes(codes: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit code for each k consecutive codes (len(codes) - k + 1 of them), by doubling."""
    n = len(codes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, length, power, span = None, 0, codes.astype(np.uint64), 1
    with np.errstate(over="ignore"):
        base, scale = BASE, np.uint64(1)
        while True:
            if k & span:
                part = power[length : length + n] * scale
                out = part if out is None else out + part
                length += span
                scale = scale * base
            span *= 2
            if span > k:
                return mix(out)
            power = power[: -(span // 2)] + power[span // 2 :] * base
            base = base * base


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each w consecutive values, by doubling."""
    n, span = len(x) - w + 1, 1
    if n <= 0:
        return x[:0]
    while span * 2 <= w:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[:n], x[w - span : w - span + n])


def _powers(n: int, base: int) -> np.ndarray:
    """base^0 to base^(n - 1), modulo 2^64."""
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


_LETTER = mix(np.arange(1, 257, dtype=np.uint64))
_tables: list[np.ndarray] = []


def word_codes(words: pa.Array, step: int = 100_000) -> np.ndarray:
    """A stable 64-bit code of each word: a polynomial in its bytes. Words aren't empty; step of them are read at once."""
    _, bounds, data = words.buffers()
    at = np.frombuffer(bounds, np.int64)[words.offset : words.offset + len(words) + 1]
    raw = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    out = np.empty(len(words), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, len(words), step):
            begin = at[i : i + step + 1]
            size = int(begin[-1] - begin[0])
            if not _tables or len(_tables[0]) < size:
                # powers of the base, and of its inverse: they bring each word back to its own first byte
                _tables[:] = _powers(size * 5 // 4, int(BASE)), _powers(size * 5 // 4, pow(int(BASE), -1, 1 << 64))
            first = begin[:-1] - begin[0]
            sums = np.add.reduceat(_LETTER[raw[begin[0] : begin[-1]]] * _tables[0][:size], first)
            out[i : i + step] = mix(sums * _tables[1][first] + np.diff(begin).astype(np.uint64))
    return out


def chunks(batches: Iterator[pa.RecordBatch], most: int, lower: bool = False) -> Iterator[tuple[list, pa.Array, np.ndarray]]:
    """(ids, words of all texts, words of each text) for so many documents that they have about `most` bytes; null texts have no words.

    The id is the first column and the text the second. Words are runs of bytes other than blank, tab, line ends,
    vertical tab and form feed.
    """
    table = byte_table(lower)
    for ids, texts in slices(batches, most):
        yield ids.to_pylist(), *split(translated(texts, table))


def groups_of(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first place, length) of each run of equal keys."""
    if not len(sorted_keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]]))
    return first, np.diff(np.append(first, len(sorted_keys)))


def pack(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()
