"""Document fingerprints as invertible Bloom lookup sketches.

A text's paragraphs are its lines, and long lines are cut further after words whose code falls in one of CUT classes, so
that an edit changes the paragraphs around it and no others. Each distinct paragraph's 64-bit digest goes into three
cells of the sketch; a cell holds a count, the xor of digests and the xor of their check codes. The sketches of two
versions subtract cell by cell, and peeling what is left recovers the digests in which they differ: a cell with one
digest gives it away, and removing it from its other cells frees more. Where peeling gets stuck the sketches were too
small for the difference, and larger ones are made from the texts until it succeeds.

The fingerprint is the sketch of CELLS cells in base64, with the number of paragraphs. Equal texts have equal
fingerprints. Likeness is the share of common paragraphs in all of both texts (1 for two texts without words).

Null texts count as empty. The next document is that of the next smaller id, after the smallest the largest; rows that
repeat an id follow each other in the order of their texts, and null ids come last. A single document is its own next.
An empty table gives no rows. Other columns don't matter.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import ship_package
from fleetlens.llm.wordcodes import BASE, mix, word_codes
from fleetlens.llm.words import split

CELLS, HASHES, CUT = 36, 3, 6
#: Words that a task fingerprints at once.
CHUNK_WORDS = 400_000
LINE = b"\x00"


def paragraphs(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(distinct digests of all texts, ascending within a text; how many each has)."""
    words, n = split(pc.replace_substring(pa.array(texts, pa.large_binary()), b"\n", b" \x00 ").cast(pa.large_utf8()))
    total = len(words)
    if not total:
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    codes, line = word_codes(words), word_codes(pa.array([LINE], pa.large_binary()))[0]
    last = (codes % np.uint64(CUT) == 0) | (codes == line)
    last[np.cumsum(n[n > 0]) - 1] = True
    first = np.concatenate([[0], np.flatnonzero(last)[:-1] + 1])
    piece = np.repeat(np.arange(len(first)), np.diff(np.append(first, total)))
    with np.errstate(over="ignore"):
        place = (np.arange(total) - first[piece]).astype(np.uint64)
        digests = mix(np.add.reduceat(mix(codes + place * BASE), first))
    row = np.repeat(np.arange(len(n)), n)[first]
    # a line end alone is no paragraph
    full = ~((codes[first] == line) & (np.diff(np.append(first, total)) == 1))
    digests, row = digests[full], row[full]
    count = np.bincount(row, minlength=len(n))
    ends = np.cumsum(count)
    for a, b in zip((ends - count).tolist(), ends.tolist()):
        digests[a:b].sort()
    new = np.ones(len(digests), bool)
    new[1:] = (digests[1:] != digests[:-1]) | (row[1:] != row[:-1])
    return digests[new], np.bincount(row[new], minlength=len(n))


class Sketches:
    """One sketch for each of n texts, of `cells` cells each."""

    def __init__(self, n: int, cells: int):
        self.n, self.third = n, -(-cells // HASHES)
        self.cells = self.third * HASHES
        self.count = np.zeros(n * self.cells, np.int32)
        self.key = np.zeros(n * self.cells, np.uint64)
        self.check = np.zeros(n * self.cells, np.uint64)

    def toggle(self, row: np.ndarray, key: np.ndarray, sign: np.ndarray | int) -> None:
        """Adds (sign 1) or takes out (-1) keys; each hash has its own third of the cells."""
        check = mix(key ^ np.uint64(0xA5A5A5A5A5A5A5A5))
        with np.errstate(over="ignore"):
            for h in range(HASHES):
                cell = row * self.cells + h * self.third + (mix(key + np.uint64(h + 1) * BASE) % np.uint64(self.third)).astype(np.int64)
                np.add.at(self.count, cell, sign)
                np.bitwise_xor.at(self.key, cell, key)
                np.bitwise_xor.at(self.check, cell, check)

    @classmethod
    def of(cls, keys: np.ndarray, n: np.ndarray, cells: int) -> Sketches:
        out = cls(len(n), cells)
        out.toggle(np.repeat(np.arange(len(n)), n), keys, 1)
        return out

    def minus(self, other: Sketches) -> Sketches:
        out = Sketches(self.n, self.cells)
        out.count, out.key, out.check = self.count - other.count, self.key ^ other.key, self.check ^ other.check
        return out

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(digests only in the first, only in the second, whether all were recovered), counted for each sketch."""
        gained, lost = np.zeros(self.n, np.int64), np.zeros(self.n, np.int64)
        look = np.flatnonzero(np.abs(self.count) == 1)
        while True:
            pure = look[(np.abs(self.count[look]) == 1) & (mix(self.key[look] ^ np.uint64(0xA5A5A5A5A5A5A5A5)) == self.check[look])]
            if not len(pure):
                break
            row, key, sign = pure // self.cells, self.key[pure], self.count[pure]
            order = np.lexsort((key, row))
            row, key, sign = row[order], key[order], sign[order]
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1])
            row, key, sign = row[new], key[new], sign[new]
            gained += np.bincount(row[sign > 0], minlength=self.n)
            lost += np.bincount(row[sign < 0], minlength=self.n)
            self.toggle(row, key, -sign)
            touched = np.isin(np.arange(self.n), row)
            look = np.flatnonzero(np.repeat(touched, self.cells) & (np.abs(self.count) == 1))
        left = (self.count != 0) | (self.key != 0)
        return gained, lost, ~left.reshape(self.n, self.cells).any(1)

    def strings(self, n: np.ndarray) -> list[str]:
        """Each sketch in base64, behind the number of paragraphs."""
        count, key, check = (x.reshape(self.n, self.cells) for x in (self.count.astype("<u2"), self.key, (self.check >> np.uint64(32)).astype("<u4")))
        return [f"{m}:" + base64.b64encode(c.tobytes() + k.tobytes() + x.tobytes()).decode() for m, c, k, x in zip(n.tolist(), count, key, check)]


def likeness(a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Share of common paragraphs in all, for pairs of texts; digests as paragraphs() gives them."""
    out = np.ones(len(n_a))
    todo = np.flatnonzero(n_a + n_b > 0)
    ends_a, ends_b = np.cumsum(n_a), np.cumsum(n_b)

    def some(keys: np.ndarray, n: np.ndarray, ends: np.ndarray, rows: np.ndarray) -> np.ndarray:
        m = n[rows]
        return keys[np.repeat(ends[rows] - m - (np.cumsum(m) - m), m) + np.arange(m.sum())]

    cells = CELLS
    while len(todo):
        step = max(1, 3_000_000 // cells)
        stuck = []
        for i in range(0, len(todo), step):
            rows = todo[i : i + step]
            left = Sketches.of(some(a, n_a, ends_a, rows), n_a[rows], cells)
            gained, lost, done = left.minus(Sketches.of(some(b, n_b, ends_b, rows), n_b[rows], cells)).peel()
            common = (n_a[rows] - gained + n_b[rows] - lost) / 2
            out[rows[done]] = (common / (common + gained + lost))[done]
            stuck.append(rows[~done])
        todo, cells = np.concatenate(stuck), cells * 4
    return out


def edited(text: str, following: str) -> str:
    """The last half of text's characters replaced by as many, or all, of the following text's first."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def in_order(docs: DataFrame, partitions: int, id_col: str, text_col: str) -> DataFrame:
    """(slot, copy, doc_id, text), slots whole in a partition, ids descending in a slot; behind each slot, the next one's first."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    keyed = rows.withColumn("key", F.col("doc_id").cast("double"))
    bounds = keyed.approxQuantile("key", [i / partitions for i in range(1, partitions)], 0.2 / partitions) if partitions > 1 else []
    splits = [-float("inf"), *(sorted(set(bounds)) or [0.0]), float("inf")]
    placed = Bucketizer(splits=splits, inputCol="key", outputCol="b", handleInvalid="keep").transform(keyed)
    # largest ids first, null ids last
    slot = F.when(F.col("doc_id").isNull(), len(splits)).otherwise(len(splits) - F.col("b")).cast("int")
    placed = placed.select("doc_id", "text", slot.alias("slot"))
    # a row for each slot: there are as many as partitions
    heads = placed.groupBy("slot").agg(F.max("doc_id").alias("head")).orderBy("slot").collect()
    spark = docs.sparkSession
    to = spark.createDataFrame([(h.slot, h.head, heads[i - 1].slot) for i, h in enumerate(heads)], "h_slot int, head long, before int")
    both = placed.join(F.broadcast(to), (F.col("slot") == F.col("h_slot")) & F.col("doc_id").eqNullSafe(F.col("head")), "left")
    own = F.struct(F.col("slot"), F.lit(0).alias("copy"))
    again = F.struct(F.col("before").alias("slot"), F.lit(1).alias("copy"))
    dealt = both.select(F.explode(F.when(F.col("before").isNull(), F.array(own)).otherwise(F.array(own, again))).alias("x"), "doc_id", "text")
    dealt = dealt.select("x.slot", "x.copy", "doc_id", "text")
    return dealt.repartition(partitions, "slot").sortWithinPartitions("slot", "copy", F.col("doc_id").desc_nulls_last(), F.xxhash64("text"), "text")


def fingerprint_versions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for every row."""
    spark = docs.sparkSession
    ship_package(spark)
    partitions = max(1, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))

    def rows(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        """held: (slot, copy, doc, text); the last one only follows."""
        at = [i for i in range(len(held) - 1) if not held[i][1]]
        # behind a slot's rows comes at least one copy, so the next row is of the same slot
        texts = [r[3] for r in held]
        versions = [edited(texts[i], texts[i + 1]) for i in at]
        raw = [v.encode() for v in versions]
        keys, n = paragraphs([t.encode() for t in texts])
        e_keys, e_n = paragraphs(raw)
        ends = np.cumsum(n)
        pick = lambda index: np.concatenate([np.zeros(0, np.uint64), *(keys[ends[i] - n[i] : ends[i]] for i in index)])
        mine, after = np.array(at, np.int64), np.array(at, np.int64) + 1
        own, n_own = pick(at), n[mine]
        print_of = Sketches.of(own, n_own, CELLS).strings(n_own)
        columns = [
            pa.array([held[i][2] for i in at], pa.int64()),
            pa.array([len(texts[i]) for i in at], pa.int64()),
            pa.array([hashlib.sha256(r).hexdigest() for r in raw], pa.string()),
            pa.array(print_of, pa.string()),
            pa.array(Sketches.of(e_keys, e_n, CELLS).strings(e_n), pa.string()),
            pa.array(likeness(own, n_own, e_keys, e_n), pa.float64()),
            pa.array(likeness(own, n_own, pick(after.tolist()), n[after]), pa.float64()),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for b in batches:
            for r in zip(*(b.column(i).to_pylist() for i in range(4))):
                held.append(r)
                size += len(r[3])
                if size > 6 * CHUNK_WORDS and len(held) > 1:
                    yield from rows(held)
                    held, size = held[-1:], len(held[-1][3])
        if len(held) > 1:
            yield from rows(held)

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return in_order(docs, partitions, id_col, text_col).mapInArrow(task, schema)
