"""Exact removal of passages that repeat, by super-k-mer partitioning.

A window is k consecutive words. Its minimiser is the least code of the m-word runs in it; consecutive windows that
share a minimiser travel as one packed string to the minimiser's bucket, so that equal windows meet there. In a bucket
the windows are sorted and compared word by word: codes only order them. A window repeats if the same words start
earlier: in a document of smaller id, or earlier in the same document. Every word that a repeating window covers goes.

Buckets are as many as the bytes of all texts ask for. Skew: each task first compares its own windows, chunk by chunk, and
sends of equal ones the earliest only, so a passage that stands in a third of all documents travels once a chunk. A pass
over the minimisers alone counts how many words each would bring to its bucket. Tasks leave out what is under an eighth
of a bucket's share of their own words, so that every minimiser of half a bucket's share of all words is found; windows
of these are dealt by all their words instead of the minimiser, one string each. They are known by marks in a bitmap of
HOT_BITS bits, whatever the table's size; a stranger that falls on a mark is only dealt otherwise.

Rows decide, not ids: a row is known by its id and a 64-bit code of id and text. So rows of one id with different texts
are apart (the smaller code counts as the earlier), rows that repeat both count as the same document and none of them
loses what only they have, and rows without an id come last. Null and empty texts have no words and nothing to remove;
texts under k words have no window; texts of any length are read whole. An empty table gives no rows. Other columns
don't matter, whatever their names; without_repeats keeps them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import buckets_for, renamed, ship_package, written
from fleetlens.llm.wordcodes import chunks, groups_of, mix, pack, run_codes, sliding_min, word_codes
from fleetlens.llm.words import byte_table, joined, split, tidy, translated

#: Bytes of text that a task compares at once, and that one bucket has windows of, on average.
CHUNK_BYTES, BUCKET_BYTES = 3_000_000, 4_000_000
#: Words of a minimiser.
M = 3
#: Marks of minimisers with more than a bucket's share; a multiple of what one of Spark's bitmaps holds.
HOT_BITS, BITMAP = 1 << 26, 32_768


class Windows:
    """The windows of one chunk. keys: (doc_id, tie) of each text; n: words of each text."""

    def __init__(self, keys: list[dict], words: pa.Array, n: np.ndarray, k: int):
        rows = np.flatnonzero(n >= k)
        self.k, self.empty, self.words = k, not len(rows), words
        if self.empty:
            return
        codes = word_codes(words)
        begin, per_doc = (np.cumsum(n) - n)[rows], n[rows] - k + 1
        #: first word of each window
        self.at = np.repeat(begin - (np.cumsum(per_doc) - per_doc), per_doc) + np.arange(per_doc.sum())
        self.id, self.tie = np.array([(keys[i]["doc_id"], keys[i]["tie"]) for i in rows], np.int64).T
        #: rank of each window's document in the chunk, and the place of a text of that rank
        rank, self.text_of = ranks(self.id, self.tie)
        self.doc = np.repeat(rank, per_doc)
        self.row = np.repeat(np.arange(len(rows)), per_doc)
        self.start = self.at - np.repeat(begin, per_doc)
        m = min(M, k)
        self.codes = codes
        self.minimiser = sliding_min(run_codes(codes, m), k - m + 1)[self.at]

    def runs(self, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first, length) of the runs of kept, consecutive windows of one document with one minimiser."""
        w = np.flatnonzero(keep)
        if not len(w):
            return w, w
        new = (np.diff(w) != 1) | (self.row[w[1:]] != self.row[w[:-1]]) | (self.minimiser[w[1:]] != self.minimiser[w[:-1]])
        first = np.flatnonzero(np.concatenate([[True], new]))
        return w[first], np.diff(np.append(first, len(w)))

    def code(self) -> np.ndarray:
        return run_codes(self.codes, self.k)[self.at]


class Words:
    """A sequence of words as one text with one blank between words."""

    def __init__(self, words: pa.Array):
        self.text = memoryview(joined(words, np.array([0, len(words)]))[0].as_buffer())
        self.begin = np.concatenate([[0], np.cumsum(pc.binary_length(words).to_numpy() + 1)])

    def __call__(self, first: np.ndarray, n: np.ndarray | int) -> Iterator[memoryview]:
        """The n words from each first one on."""
        return (self.text[i : j - 1] for i, j in zip(self.begin[first].tolist(), self.begin[first + n].tolist()))


def repeats(code: np.ndarray, doc: np.ndarray, start: np.ndarray, at: np.ndarray, words: Words, k: int) -> np.ndarray:
    """Marks the windows whose words also start earlier. at: place in words of each window's first word."""
    out = np.zeros(len(code), bool)
    order = np.argsort(code)
    first, length = groups_of(code[order])
    several = length > 1
    member = order[np.repeat(several, length)]
    if not len(member):
        return out
    n = length[several]
    group = np.repeat(np.arange(len(n)), n)
    place = doc[member] << 32 | start[member]
    least = np.minimum.reduceat(place, np.cumsum(n) - n)[group]
    head = np.empty(len(n), np.int64)  # the earliest of each group
    head[group[place == least]] = member[place == least]
    later = place != least
    mine, its = member[later], head[group[later]]
    order = np.argsort(mine)
    mine, its = mine[order], its[order]
    # windows that follow each other, and whose heads do, are compared at once
    new = np.ones(len(mine), bool)
    new[1:] = (np.diff(at[mine]) != 1) | (np.diff(at[its]) != 1)
    first = np.flatnonzero(new)
    length = np.diff(np.append(first, len(mine)))
    same = np.fromiter((a == b for a, b in zip(words(at[mine[first]], length + k - 1), words(at[its[first]], length + k - 1))), bool, len(first))
    out[mine[np.repeat(same, length)]] = True
    if not same.all():  # two word sequences share a code: compare all windows of that code by their words
        for c in np.unique(code[mine[~np.repeat(same, length)]]):
            seen: dict[bytes, tuple] = {}
            windows = np.flatnonzero(code == c)
            windows = windows[np.lexsort((start[windows], doc[windows]))]
            for w, text in zip(windows, words(at[windows], k)):
                out[w] = seen.setdefault(bytes(text), (doc[w], start[w])) != (doc[w], start[w])
    return out


def ranks(doc: np.ndarray, tie: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rank of each pair among the distinct pairs, a place of the pair of each rank)."""
    order = np.lexsort((tie, doc))
    d, t = doc[order], tie[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (t[1:] != t[:-1])
    out = np.empty(len(d), np.int64)
    out[order] = np.cumsum(new) - 1
    return out, order[new]


def as_runs(doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows as runs (doc, first start, number of windows)."""
    order = np.lexsort((start, doc))
    d, s = doc[order], start[order]
    if not len(d):
        return d, s, s
    first = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (s[1:] > s[:-1] + 1)]))
    last = np.append(first[1:], len(d)) - 1
    return d[first], s[first], s[last] - s[first] + 1


class Marks:
    """The minimisers that are dealt by all their words. bitmaps: (number, bits) as Spark makes them."""

    def __init__(self, bitmaps: list[tuple[int, bytes]]):
        self.of = np.full(HOT_BITS // BITMAP, -1)
        self.of[[number - 1 for number, _ in bitmaps]] = np.arange(len(bitmaps))
        self.bits = np.frombuffer(b"".join(bits for _, bits in bitmaps), np.uint8).reshape(len(bitmaps), BITMAP // 8)

    def holds(self, minimiser: np.ndarray) -> np.ndarray:
        if not len(self.bits):
            return np.zeros(len(minimiser), bool)
        slot = (minimiser % np.uint64(HOT_BITS)).astype(np.int64)
        which = self.of[slot // BITMAP]
        return (which >= 0) & (self.bits[which, slot % BITMAP // 8] >> (slot % 8) & 1).astype(bool)


def hot_minimisers(texts: DataFrame, k: int, buckets: int) -> Marks:
    """Marks of all minimisers that would bring half a bucket's share of all words; every row counts."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, words, total = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0
        for ids, found, n in chunks(batches, CHUNK_BYTES):
            x = Windows(ids, found, n, k)
            if x.empty:
                continue
            first, length = x.runs(np.ones(len(x.at), bool))
            total += int(length.sum()) + (k - 1) * len(length)
            key, place = np.unique(np.concatenate([key, x.minimiser[first]]), return_inverse=True)
            words = np.bincount(place, np.concatenate([words, length + k - 1]), len(key)).astype(np.int64)
        told = words * 8 * buckets >= total
        yield pa.RecordBatch.from_pydict({"minimiser": key[told].astype(np.int64), "words": words[told], "total": np.zeros(told.sum(), np.int64)})
        yield pa.RecordBatch.from_pydict({"minimiser": np.zeros(1, np.int64), "words": np.zeros(1, np.int64), "total": np.array([total])})

    counted = texts.mapInArrow(task, "minimiser long, words long, total long").groupBy("minimiser").agg(F.sum("words").alias("words"), F.sum("total").alias("total"))
    counted = written(counted, "minimisers")
    total = counted.agg(F.sum("total")).first()[0] or 0
    # what tasks left out is an eighth of a bucket's share at most
    slot = F.pmod("minimiser", F.lit(HOT_BITS)) + 1
    hot = counted.where((F.col("words") > 0) & (F.col("words") * 8 * buckets >= 3 * total)).select(slot.alias("slot"))
    bitmaps = hot.groupBy(F.bitmap_bucket_number("slot").alias("number")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
    # HOT_BITS bits at most
    return Marks([(r.number, bytes(r.bits)) for r in bitmaps.collect()])


def _row_key(id_col: str, text_col: str) -> tuple[Column, Column]:
    """(doc_id, tie) of a row; a null id counts as the greatest."""
    return F.coalesce(F.col(id_col).cast("long"), F.lit(2**63 - 1)), F.xxhash64(F.col(id_col), F.col(text_col))


def duplicate_windows(docs: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, tie, start, windows): runs of windows that start earlier elsewhere, by _row_key; starts count words from 0."""
    ship_package(docs.sparkSession)
    doc, tie = _row_key(id_col, text_col)
    texts = docs.select(F.struct(doc.alias("doc_id"), tie.alias("tie")).alias("key"), F.col(text_col).cast("binary").alias("text"))
    buckets = buckets_for(texts, BUCKET_BYTES)
    hot = hot_minimisers(texts, k, buckets)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(3).compress
        for ids, words, n in chunks(batches, CHUNK_BYTES):
            x = Windows(ids, words, n, k)
            if x.empty:
                continue
            code, text = x.code(), Words(words)
            again = repeats(code, x.doc, x.start, x.at, text, k)
            rows = []
            if again.any():
                d, s, n = as_runs(x.doc[again], x.start[again])
                # the window's own order spreads them
                at = x.text_of[d]
                rows.append((-1 - int((x.id[at[0]] ^ x.tie[at[0]]) % buckets), pack(x.id[at]), pack(x.tie[at]), pack(s), pack(n), None))
            alone = ~again & hot.holds(x.minimiser)
            first, n = x.runs(~again & ~alone)
            single = np.flatnonzero(alone)
            first, n = np.concatenate([first, single]), np.concatenate([n, np.ones(len(single), np.int64)])
            key = mix(np.where(alone[first], code[first], x.minimiser[first])) if len(first) else code[:0]
            bucket = (key % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            for a, c in zip(*groups_of(bucket[order])):
                part = order[a : a + c]
                f, m = first[part], n[part]
                string = b" ".join(text(x.at[f], m + k - 1))
                at = x.text_of[x.doc[f]]
                rows.append((int(bucket[part[0]]), pack(x.id[at]), pack(x.tie[at]), pack(x.start[f]), pack(m), squeeze(string)))
            for i in range(0, len(rows), 256):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 256]), (pa.int64(), *[pa.binary()] * 5))], ["bucket", "docs", "ties", "starts", "counts", "words"])

    def bucket(g: pd.DataFrame) -> pd.DataFrame:
        ints = lambda c: np.frombuffer(b"".join(g[c]), np.int64)
        ids, ties, start, n = ints("docs"), ints("ties"), ints("starts"), ints("counts")
        doc, text_of = ranks(ids, ties)
        if g["bucket"].iloc[0] >= 0:
            unsqueeze = zstandard.ZstdDecompressor().decompress
            found = split(pa.array([unsqueeze(b) for b in g["words"]], pa.large_binary()).cast(pa.large_utf8()))[0]
            words = n + k - 1
            within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            at = np.repeat(np.cumsum(words) - words, n) + within
            doc, start = np.repeat(doc, n), np.repeat(start, n) + within
            again = repeats(run_codes(word_codes(found), k)[at], doc, start, at, Words(found), k)
            doc, start, n = as_runs(doc[again], start[again])
        at = text_of[doc]
        tidy()
        return pd.DataFrame({"doc_id": ids[at], "tie": ties[at], "start": start, "windows": n})

    sent = texts.mapInArrow(cut, "bucket long, docs binary, ties binary, starts binary, counts binary, words binary")
    return sent.groupBy("bucket").applyInPandas(bucket, "doc_id long, tie long, start long, windows long")


def kept(texts: pa.Array, runs: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(words of each text, how many of them repeat, the others with one blank between them). runs: lists of (start, windows)."""
    words, n = split(translated(texts, byte_table(lower=False)))
    begin = np.cumsum(n) - n
    if isinstance(runs, pa.ChunkedArray):
        runs = runs.combine_chunks()
    flat, row = runs.flatten(), pc.list_parent_indices(runs).to_numpy()
    first = begin[row] + flat.field("start").to_numpy()
    # +1 where a run begins, -1 behind its last word
    step = np.zeros(len(words) + 1, np.int64)
    np.add.at(step, first, 1)
    np.add.at(step, first + flat.field("windows").to_numpy() + k - 1, -1)
    keep = np.cumsum(step[:-1]) == 0
    left = np.concatenate([[0], np.cumsum(keep)])
    ends = left[np.concatenate([begin, [len(words)]])]
    return n, n - np.diff(ends), joined(words if keep.all() else words.filter(pa.array(keep)), ends).cast(pa.string())


def _with_runs(docs: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """docs and __runs, array of (start, windows), null where nothing repeats."""
    runs = duplicate_windows(docs, k, id_col, text_col).groupBy(F.col("doc_id").alias("__id"), F.col("tie").alias("__tie")).agg(F.collect_list(F.struct("start", "windows")).alias("__runs"))
    doc, tie = _row_key(id_col, text_col)
    return docs.join(runs.hint("shuffle_hash"), (doc == F.col("__id")) & (tie == F.col("__tie")), "left")


def without_repeats(docs: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """docs, all rows and columns, without the words that repeat; texts that lose nothing stay as they are.

    What stays of a text are its kept words with one blank between them; length_col, where docs has it, is counted anew.
    """

    @F.arrow_udf("string")
    def cut(texts: pa.Array, runs: pa.Array) -> pa.Array:
        return kept(texts, runs, k)[2]

    docs, name, back = renamed(docs)
    id_col, text_col, length_col = name[id_col], name[text_col], name.get(length_col)
    some = F.col("__runs").isNotNull()
    # texts without repeats don't travel to Python
    out = _with_runs(docs, k, id_col, text_col).withColumn("__cut", F.when(some, cut(F.when(some, F.col(text_col)), "__runs")).otherwise(F.col(text_col)))
    if length_col:
        out = out.withColumn(length_col, F.when(some, F.length("__cut").cast(docs.schema[length_col].dataType)).otherwise(F.col(length_col)))
    return back(out.withColumn(text_col, F.col("__cut")))


def substring_dedup(docs: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text) for every row: kept words with one blank between them."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, gone, text = kept(b.column("text"), b.column("runs"), k)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n), pa.array(gone), text], ["doc_id", "n_words", "n_removed", "kept_text"])

    rows = _with_runs(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), k, "doc_id", "text")
    return rows.select("doc_id", "text", F.col("__runs").alias("runs")).mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept_text string")
