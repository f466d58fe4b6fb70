"""Ranked lexical search: an inverted index in blocks, searched shard by shard with Block-Max MaxScore.

`build_index` turns documents into posting lists, a shard for about `SHARD_BYTES` of text, without a shuffle: each task
indexes what it reads. A list is cut into blocks of `BLOCK` postings, packed by themselves (gaps of document numbers and
counts, as few bytes each as the block needs). A block carries its impacts: those pairs (count of the term, length of the
document) that no other pair of the block beats, so that its largest score is exact whatever the corpus' averages are.

`search` takes the lists of the queries' terms to their shards. In a shard, lists are ordered by their bounds; those that
together can't lift a document over the score to beat are non-essential. Documents of essential lists are added up in
ranges of document numbers; a non-essential list's block is unpacked only if its largest score can still lift a
candidate over the score to beat. Shard results of at most k documents meet in one ranking by query.

Scores are 64-bit integers as in `Scale`. Terms are maximal runs of letters, digits and characters beyond ASCII, A-Z
lower-cased. A null text has no term and counts nowhere. Rows that repeat an id are documents of their own, with ranks of
their own. Documents without an id rank behind others of the same score. Queries that repeat an id are one query of all
their terms; those without an id are one query too. Queries without terms, or whose terms stand nowhere, have no rows.
Empty tables give no rows. Extra columns don't matter. A very long text is a shard of its own.
"""

from __future__ import annotations

import string
import uuid
from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetlens.llm.common import lower_ascii, shared_dir, ship_package
from fleetlens.llm.wordcodes import groups_of
from fleetlens.llm.words import byte_table, slices, split, translated

BLOCK = 128
SHARD_BYTES = 16 << 20
#: Document numbers that essential lists are added up for at once: few at first, for a score to beat, then this many times more.
RANGE, WIDER = 2048, 4
#: Queries that are searched together in a shard.
QUERY_BLOCK = 256
#: Pairs of query and term that are broadcast at most (some 20 bytes each); more are joined by a shuffle.
BROADCAST_PAIRS = 400_000
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: The list of a shard's documents stands under this term, which no text has.
DOCUMENTS = ""
INDEX = "shard long, term string, df long, total long, blocks binary, impacts binary, data binary, ids array<bigint>"
#: Numbers of a block: its last document, where its data and its impacts end, bytes of a gap, bytes of a count.
FIELDS = 5


class Scale(NamedTuple):
    """What scores need to know of the corpus: documents with a term, and terms of all documents."""

    n: int
    total: int

    def norm(self, lengths: np.ndarray) -> np.ndarray:
        return 100 - 50 + (50 * lengths.astype(np.int64) * self.n) // self.total

    def part(self, count: np.ndarray, norm: np.ndarray) -> np.ndarray:
        """A term's share of a score, for weight 1."""
        count = count.astype(np.int64)
        return (1_000_000_000 * count) // (1000 * count + 20 * norm)


# ---- index


def _packed(values: np.ndarray, width: np.ndarray, at: np.ndarray, out: np.ndarray) -> None:
    """Writes each value's `width` low bytes to out, from `at` on."""
    for j in range(4):
        wide = width > j
        out[at[wide] + j] = (values[wide] >> 8 * j) & 255


def _bytes_for(most: np.ndarray) -> np.ndarray:
    return np.where(most < 1 << 8, 1, np.where(most < 1 << 16, 2, 4))


def _ranked(block: np.ndarray, tf: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """tf and n inside each block by falling tf, then rising n. Blocks are numbered in their order."""
    t_bits, n_bits = int(tf.max(initial=0)).bit_length(), int(n.max(initial=0)).bit_length()
    if len(block) and int(block[-1]).bit_length() + t_bits + n_bits > 63:
        order = np.lexsort((n, -tf, block))
        return tf[order], n[order]
    # all three in one number sort much faster than their places do
    most = (1 << t_bits) - 1
    key = ((block << t_bits | most - tf) << n_bits) | n
    key.sort()
    return most - (key >> n_bits & most), key & (1 << n_bits) - 1


def _binary(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """data cut at ends (in bytes)."""
    return pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.binary())


def shard_lists(shard: int, ids: pa.Array, texts: pa.Array) -> pa.RecordBatch:
    """The posting lists of some documents, and the list of the documents themselves."""
    words, per = split(translated(texts, byte_table(words=string.digits + string.ascii_letters)))
    n_docs = len(ids)
    # documents are numbered in the order of their ids, those without one last
    by_id = np.asarray(pa.compute.sort_indices(ids, null_placement="at_end")).astype(np.int64)
    number = np.empty(n_docs, np.int64)
    number[by_id] = np.arange(n_docs)
    lengths = per[by_id]
    coded = words.dictionary_encode()
    key = coded.indices.to_numpy().astype(np.int64) * n_docs + np.repeat(number, per)
    key.sort()
    first, tf = groups_of(key)
    key = key[first]
    term, doc = key // n_docs, key % n_docs
    # blocks: runs of at most BLOCK postings of a term
    t_first, t_len = groups_of(term)
    within = np.arange(len(doc)) - np.repeat(t_first, t_len)
    b_first = np.flatnonzero(within % BLOCK == 0)
    b_len = np.diff(np.append(b_first, len(doc)))
    block = np.repeat(np.arange(len(b_first)), b_len)
    gap = np.diff(doc, prepend=0)
    gap[t_first] = doc[t_first]
    gw, tw = (_bytes_for(np.maximum.reduceat(x, b_first) if len(b_first) else x) for x in (gap, tf))
    b_end = np.cumsum(b_len * (gw + tw))
    data, begin, inside = np.zeros(int(b_end[-1]) if len(b_end) else 0, np.uint8), b_end - b_len * (gw + tw), np.arange(len(doc)) - b_first[block]
    _packed(gap, gw[block], begin[block] + inside * gw[block], data)
    _packed(tf, tw[block], (begin + b_len * gw)[block] + inside * tw[block], data)
    # impacts: by falling count, those whose document is shorter than all before
    n = lengths[doc]
    tf_up, n_up = _ranked(block, tf, n)
    ranked = n_up - block * (int(n.max(initial=0)) + 1)
    least = np.minimum.accumulate(ranked) if len(ranked) else ranked
    beats = np.ones(len(doc), bool)
    beats[1:] = ranked[1:] < least[:-1]
    beats[b_first] = True
    pairs = np.stack([tf_up[beats], n_up[beats]], 1).astype(np.int32)
    i_end = np.cumsum(np.bincount(block[beats], minlength=len(b_first)))
    # ends are counted from the first block of the term
    last_block = np.cumsum(-(-t_len // BLOCK)) - 1
    of_term = np.repeat(np.arange(len(t_first)), -(-t_len // BLOCK))
    d_end, p_end = b_end[last_block], i_end[last_block]
    fields = np.stack([doc[b_first + b_len - 1], b_end - np.concatenate([[0], d_end])[of_term], i_end - np.concatenate([[0], p_end])[of_term], gw, tw], 1).astype(np.int32)
    # the terms in the order of their codes, then the documents
    names = pa.concat_arrays([coded.dictionary.cast(pa.string()), pa.array([DOCUMENTS])])
    ends = lambda x, extra: np.append(x, (x[-1] if len(x) else 0) + extra)
    sizes = lengths.astype(np.int32)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(len(names), shard)),
            names,
            pa.array(np.append(t_len, np.count_nonzero(lengths)).astype(np.int64)),
            pa.array(np.append(np.zeros(len(t_len), np.int64), lengths.sum()).astype(np.int64)),
            _binary(fields.view(np.uint8).ravel(), ends((last_block + 1) * FIELDS * 4, 0)),
            _binary(pairs.view(np.uint8).ravel(), ends(p_end * 8, 0)),
            _binary(np.concatenate([data, sizes.view(np.uint8)]), ends(d_end, 4 * n_docs)),
            pa.ListArray.from_arrays(pa.array([*np.zeros(len(t_len) + 1, np.int32), n_docs], pa.int32()), ids.take(pa.array(by_id)).cast(pa.int64())),
        ],
        names=["shard", "term", "df", "total", "blocks", "impacts", "data", "ids"],
    )


def _index_task(batches: Iterator[pa.RecordBatch], shard_bytes: int) -> Iterator[pa.RecordBatch]:
    base = TaskContext.get().partitionId() << 32
    for i, (ids, texts) in enumerate(slices(batches, shard_bytes)):
        yield shard_lists(base + i, ids, texts)


def build_index(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int | None = None) -> None:
    """Writes the index of all documents as a Parquet table."""
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col))
    rows.mapInArrow(partial(_index_task, shard_bytes=shard_bytes or SHARD_BYTES), INDEX).write.parquet(path)


# ---- search


_NONE = np.zeros(0, np.int64)


class Postings:
    """A term's list in a shard. Blocks are unpacked when asked for, once."""

    def __init__(self, weight: int, blocks: bytes, impacts: bytes, data: bytes, scale: Scale, norm: np.ndarray):
        fields = np.frombuffer(blocks, np.int32).reshape(-1, FIELDS).astype(np.int64)
        self.last, self.end, self.gap_bytes, self.count_bytes = fields[:, 0], fields[:, 1], fields[:, 3], fields[:, 4]
        tf, n = np.frombuffer(impacts, np.int32).reshape(-1, 2).T
        parts = weight * scale.part(tf, scale.norm(n))
        self.block_most = np.maximum.reduceat(parts, np.concatenate([[0], fields[:-1, 2]]))
        self.bound = int(self.block_most.max())
        self.weight, self.data, self.scale, self.norm = weight, data, scale, norm
        self.unpacked: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.ranges: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def block(self, b: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of a block."""
        if (found := self.unpacked.get(b)) is None:
            begin, end, g, c = int(self.end[b - 1]) if b else 0, int(self.end[b]), int(self.gap_bytes[b]), int(self.count_bytes[b])
            n = (end - begin) // (g + c)
            docs = np.cumsum(np.frombuffer(self.data, f"<u{g}", n, begin), dtype=np.int64)
            if b:
                docs += self.last[b - 1]
            counts = np.frombuffer(self.data, f"<u{c}", n, begin + n * g)
            found = self.unpacked[b] = docs, self.weight * self.scale.part(counts, self.norm[docs])
        return found

    def within(self, begin: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents less begin, scores) of documents from begin to before end; kept for other queries."""
        if (found := self.ranges.get(begin)) is None:
            b, stop = int(np.searchsorted(self.last, begin)), int(np.searchsorted(self.last, end - 1)) + 1
            parts = [self.block(i) for i in range(b, min(stop, len(self.last)))]
            docs, scores = (np.concatenate(x) for x in zip(*parts)) if parts else (_NONE, _NONE)
            i, j = np.searchsorted(docs, (begin, end))
            found = self.ranges[begin] = docs[i:j] - begin, scores[i:j]
        return found


def best(lists: list[Postings], n_docs: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(documents, scores) of the k best by score, equal ones by number."""
    lists = sorted(lists, key=lambda p: p.bound)
    reach = np.cumsum([p.bound for p in lists])
    top_docs, top, beat = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    end, width = 0, RANGE
    while end < n_docs:
        begin, end, width = end, min(end + width, n_docs), width * WIDER
        # numbers rise, so that a later document needs more than the score to beat
        essential = int(np.searchsorted(reach, beat, side="right"))
        if essential == len(lists):
            break
        sums = np.zeros(end - begin, np.int64)
        for p in lists[essential:]:
            docs, scores = p.within(begin, end)
            if len(docs):
                sums[docs] += scores
        docs = np.flatnonzero(sums)
        score, docs = sums[docs], docs + begin
        for i in range(essential - 1, -1, -1):
            p, rest = lists[i], int(reach[i - 1]) if i else 0
            b = np.searchsorted(p.last, docs)
            most = np.append(p.block_most, 0)[b]
            alive = score + most + rest > beat
            docs, score, b = docs[alive], score[alive], b[alive]
            if needed := np.unique(b[b < len(p.last)]).tolist():
                held, scores = (np.concatenate(x) for x in zip(*map(p.block, needed)))
                at = np.minimum(np.searchsorted(held, docs), len(held) - 1)
                score = score + np.where(held[at] == docs, scores[at], 0)
            if not len(docs):
                break
        better = score > beat
        top_docs, top = np.concatenate([top_docs, docs[better]]), np.concatenate([top, score[better]])
        if len(top) >= k:
            chosen = np.lexsort((top_docs, -top))[:k]
            top_docs, top = top_docs[chosen], top[chosen]
            beat = int(top[-1])
    chosen = np.lexsort((top_docs, -top))[:k]
    return top_docs[chosen], top[chosen]


def _search_shard(table: pa.Table, scale: Scale, k: int) -> pa.Table:
    """The best documents of one shard for each query of a block."""
    table = table.combine_chunks()
    names = table["term"].to_pylist()
    row = names.index(DOCUMENTS)
    ids = table["ids"][row].values
    norm = scale.norm(np.frombuffer(table["data"][row].as_py(), np.int32))
    by_item: dict[int | None, list[Postings]] = {}
    for i, name in enumerate(names):
        # a term that nearly all documents have may weigh nothing
        if name != DOCUMENTS and (weight := table["weight"][i].as_py()) > 0:
            p = Postings(weight, *(table[c][i].as_py() for c in ("blocks", "impacts", "data")), scale, norm)
            for item in table["items"][i].as_py():
                by_item.setdefault(item["id"], []).append(p)
    items, found, scores = [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for item, lists in by_item.items():
        docs, score = best(lists, len(norm), k)
        items += [item] * len(docs)
        found.append(docs)
        scores.append(score)
    return pa.table({"item_id": pa.array(items, pa.int64()), "doc_id": ids.take(pa.array(np.concatenate(found))), "score": pa.array(np.concatenate(scores))})


def search(queries: DataFrame, spark: SparkSession, path: str, k: int = 50, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each query in the index at path."""
    ship_package(spark)
    index = spark.read.parquet(path)
    totals = index.where(F.col("term") == DOCUMENTS).agg(F.sum("df"), F.sum("total")).first()
    scale = Scale(int(totals[0] or 0), int(totals[1] or 0))
    empty = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    if not scale.n:
        return empty
    terms = F.array_distinct(F.regexp_extract_all(lower_ascii(F.col(text_col)), F.lit(f"({TERM})"), F.lit(1)))
    pairs = queries.select(F.col(item_col).cast("long").alias("item_id"), F.explode(terms).alias("term")).distinct()
    n_pairs, n_items = pairs.agg(F.count("*"), F.count_distinct(F.coalesce("item_id", F.lit(-1)))).first()
    if not n_pairs:
        return empty
    hint = F.broadcast if n_pairs <= BROADCAST_PAIRS else lambda df: df
    df = index.select("term", "df").join(hint(pairs.select("term").distinct()), "term").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * scale.n + 2) / (2 * F.col("df").cast("double") + 1))).cast("long")
    blocks = -(-n_items // QUERY_BLOCK)
    parts = pairs.withColumn("part", F.pmod(F.xxhash64("item_id"), F.lit(blocks)).cast("int"))
    # ids in structs, as collect_list leaves nulls out
    asked = parts.groupBy("part", "term").agg(F.collect_list(F.struct(F.col("item_id").alias("id"))).alias("items")).join(df.select("term", weight.alias("weight")), "term")
    asked = asked.select("part", "term", "items", "weight").unionByName(parts.select("part", F.lit(DOCUMENTS).alias("term"), F.array().cast("array<struct<id:bigint>>").alias("items"), F.lit(0).cast("long").alias("weight")).distinct())
    lists = index.drop("df", "total").join(hint(asked), "term")
    found = lists.groupBy("shard", "part").applyInArrow(lambda table: _search_shard(table, scale, k), "item_id long, doc_id long, score long")
    order = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def ranked_search(docs: DataFrame, queries: DataFrame, k: int = 50) -> DataFrame:
    """Indexes docs in the shared folder and searches them."""
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
    build_index(docs, path)
    return search(queries, spark, path, k)
