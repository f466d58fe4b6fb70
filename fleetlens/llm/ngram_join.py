"""Jaccard join of documents on word n-grams, by T-occurrence search.

Two documents link when their sets of distinct n-grams have 100 * |A and B| >= percent * |A or B|. Result: the connected
components of all links, without listing the pairs inside a group.

1. Routing. Inverted lists over the whole corpus would be as long as the corpus is large for common n-grams, so lists are
   made within blocks of documents that may link. Linked sets of n and m elements differ in at most
   (n + m)(1 - t)/(1 + t) of them. Cut a set by hash into more parts than that: some part is the same in both. Each part's
   content is a signature; documents that share none can't link. With s parts to spare, s + 1 parts are the same, so a
   set with at most s weak parts (of so few n-grams that strangers share them) needs no signatures for these; a set with
   more gives all. Sizes fall into bands so that partners are in one band or the next, and a document gives signatures
   for both. Each task first groups its own rows, chunk by chunk: exact copies collapse, and where more than CROWD
   documents share a signature only the smallest id (the hub) goes on, so a signature that a third of all rows carry
   travels at most CROWD times a chunk. A block holds the documents that share a signature with its smallest id; those
   behind a hub follow it. So any two documents that share a signature meet in a block. Codes only route: a false meeting costs time, not truth.
2. Two rounds of comparisons. In the first each document stands only in its first block (of least number), so a text
   travels once, and what links there gets one label. In the second all blocks are looked at, but only pairs that have
   different labels and haven't met before. In both, parity bits of the sets (an eighth to a quarter of a byte for each
   n-gram) rule out documents that can't link with any other of their block before texts travel: sets differ in at least
   as many n-grams as in bits.
3. Search, inside a block: inverted lists from n-gram to documents. For each document its short lists are merged (they
   ascend, and the merge sort takes them as its runs), and what occurs often enough there is probed in the long lists by
   binary search (DivideSkip); who reaches the overlap that the threshold needs is a link. A document already connected
   with the query isn't probed again. Blocks with more n-grams than a task should hold are cut into parts, and every two
   parts meet in a task of their own.
4. Components of the links, in the shared checkpoint folder.

Words are runs of non-blank bytes, A-Z lower-cased. A text with fewer than n words, but some, is one n-gram; without
words the set is empty and links with nothing. Null texts have no words; texts of any length are read whole. Rows that
repeat an id are separate rows of one node: their links count for it, and each row keeps its own set's size. A row
without an id can't be named in a link: it is reported with a null component. keep_first decides by rows instead (a
64-bit code of id and text names each), so that rows of one id with different texts, and rows without an id, are compared
and kept or dropped one by one. Ties play no part: the overlap that the threshold needs, exactly, is a link. An empty
table gives no rows. Other columns don't matter, whatever their names; keep_first keeps them.

An n-gram is known by a 64-bit code of its words, and sets are equal if their sizes and 96 bits of sums over their codes
are: two different n-grams with one code would count as one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import batches_of, buckets_for, connected_components, renamed, ship_package, written
from fleetlens.llm.words import byte_table, split, tidy, translated
from fleetlens.llm.wordcodes import BASE, chunks, groups_of, mix, pack, run_codes, word_codes

#: Bytes of text that a task groups at once, and n-grams in one part of a block.
CHUNK_BYTES, PART_GRAMS = 4_000_000, 600_000
#: Documents of a chunk that may share a signature before one of them stands for all.
CROWD = 64
#: Text whose signatures fall into one bucket, on average.
BUCKET_BYTES = 48_000_000
#: Rows of texts that a worker gets at once.
TEXT_ROWS = 2000
#: DivideSkip's weight of a merged posting against a probe.
MU = 0.0085


def gram_sets(words: pa.Array, n: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(codes of all documents' distinct n-grams, ascending within a document; how many each has). n: words of each document."""
    grams = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    if not n.sum():
        return np.zeros(0, np.uint64), grams
    codes, begin = word_codes(words), np.cumsum(n) - n
    all_runs = run_codes(codes, k)
    first = np.cumsum(grams) - grams
    out = np.zeros(grams.sum(), np.uint64)
    row = np.repeat(np.arange(len(n)), grams)
    at = np.repeat(begin - first, grams) + np.arange(len(out))
    long = (n >= k)[row]
    out[long] = all_runs[at[long]]
    with np.errstate(over="ignore"):
        for i in np.flatnonzero((n > 0) & (n < k)):
            code = np.uint64(n[i])
            for c in codes[begin[i] : begin[i] + n[i]]:
                code = code * BASE + c
            out[first[i]] = mix(np.array([code]))[0]
    for a, b in zip(first.tolist(), (first + grams).tolist()):
        out[a:b].sort()
    new = np.ones(len(out), bool)
    new[1:] = (out[1:] != out[:-1]) | (row[1:] != row[:-1])
    return out[new], np.bincount(row[new], minlength=len(n))


@lru_cache(64)
def bands(percent: int, up_to: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each band: its least size, the number of parts for pairs from it and the next, how many of them are to spare, and how many n-grams a weak part has at most (-1: none is weak)."""
    low = [1]
    while low[-1] <= up_to * 2:
        low.append(low[-1] * 100 // percent + 1)
    edge = np.array([*low, low[-1] * 100 // percent + 1], np.int64)
    high = edge[1:] - 1
    partner = np.minimum(np.append(high[1:], high[-1] * 2), high * 100 // percent)
    need = (high + partner) * (100 - percent) // (100 + percent) + 1
    spare, weak = np.zeros(len(need), np.int64), np.full(len(need), -1)
    for i, (size, k) in enumerate(zip(low, need.tolist())):
        for most, allowed in ((1, k // 4), (0, k // 2)):
            if k * np.exp(-size / k) * (1 + most * size / k) < 0.05:
                continue  # hardly any set has one
            s = 0
            for _ in range(8):  # a set's weak parts, rarely more
                mean = (k + s) * np.exp(-size / (k + s)) * (1 + most * size / (k + s))
                s = int(np.ceil(mean + 2 * np.sqrt(mean)))
            if s <= allowed:
                spare[i], weak[i] = s, most
                break
    return edge[:-1], need + spare, spare, weak


def signatures(codes: np.ndarray, n: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(signature, row of its document), for sets as gram_sets gives them."""
    low, parts, spare, weak = bands(percent, 1 << int(n.max(initial=1)).bit_length())
    band = np.searchsorted(low, n, "right") - 1
    spread = mix(codes ^ np.uint64(0x5851F42D4C957F2D))
    halves = (spread & np.uint64(0xFFFFFFFF)).astype(np.float64), (spread >> np.uint64(32)).astype(np.float64)
    row = np.repeat(np.arange(len(n)), n)
    sigs, rows = [], []
    for shift in (0, 1):
        has = (n > 0) & (band >= shift)
        of_band = np.where(has, band - shift, 0)
        k = np.where(has, parts[of_band], 0)
        base = np.cumsum(k) - k
        use = has[row]
        slot = base[row[use]] + (codes[use] % k[row[use]].astype(np.uint64)).astype(np.int64)
        total = int(k.sum())
        owner = np.repeat(np.arange(len(n)), k)
        is_weak = np.bincount(slot, minlength=total) <= weak[of_band][owner]
        told = ~is_weak | (np.bincount(owner[is_weak], minlength=len(n)) > spare[of_band])[owner]
        # sums of 32-bit halves are exact in doubles
        low_sum, high_sum = (np.bincount(slot, h[use], total)[told].astype(np.uint64) for h in halves)
        place = (np.arange(total, dtype=np.int64) - np.repeat(base, k))[told]
        owner = owner[told]
        with np.errstate(over="ignore"):
            sig = mix(mix(low_sum) + high_sum * BASE + (of_band[owner].astype(np.uint64) << np.uint64(40)) + place.astype(np.uint64))
        sigs.append(sig)
        rows.append(owner)
    return np.concatenate(sigs), np.concatenate(rows)


def parities(codes: np.ndarray, n: np.ndarray) -> list[bytes]:
    """Each set as bits: which of 2^j slots an odd number of its n-grams fall into. 2^j is at least 256 and its size."""
    slots = np.maximum(256, 2 ** np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64))
    base = np.cumsum(slots) - slots
    row = np.repeat(np.arange(len(n)), n)
    at = base[row] + (mix(codes ^ np.uint64(0x2545F4914F6CDD1D)) & (slots[row] - 1).astype(np.uint64)).astype(np.int64)
    raw = np.packbits((np.bincount(at, minlength=int(slots.sum())) & 1).astype(np.uint8), bitorder="little").tobytes()
    return [raw[a:b] for a, b in zip((base // 8).tolist(), ((base + slots) // 8).tolist())]


class Group:
    """What is known of the documents that meet in a task: side (pairs of one side are another task's), label (equal: connected), home (two of them: compared before)."""

    def __init__(self, side: np.ndarray | None, label: np.ndarray, home: np.ndarray):
        self.side, self.label, self.home = side, label, home

    def __getitem__(self, order: np.ndarray) -> Group:
        return Group(None if self.side is None else self.side[order], self.label[order], self.home[order])

    def open(self, who: np.ndarray, i: int) -> np.ndarray:
        """Marks those of `who` that i is to be compared with, labels aside."""
        out = ~(self.home[who] & self.home[i])
        return out if self.side is None else out & (self.side[who] != self.side[i])


def may_link(bits: list[bytes], n: np.ndarray, percent: int, group: Group) -> np.ndarray:
    """Marks the sets that parities don't rule out: sets differ in at least as many n-grams as their bits do."""
    width = min(map(len, bits))
    rows = []
    for b in bits:
        x = np.frombuffer(b, np.uint64)
        while len(x) * 8 > width:  # half as many slots: the halves' parities add up
            x = x[: len(x) // 2] ^ x[len(x) // 2 :]
        rows.append(x)
    # partners of a set are among those next to it in size
    order = np.argsort(n, kind="stable")
    x, n, group = np.stack(rows)[order], n[order], group[order]
    first = np.searchsorted(100 * n, percent * n)
    out = np.zeros(len(n), bool)
    for i in range(len(n)):
        close = np.arange(first[i], i)
        close = close[group.open(close, i) & (group.label[close] != group.label[i])] if n[i] else close[:0]
        if len(close):
            near = np.bitwise_count(x[close] ^ x[i]).sum(1, dtype=np.int64) * (100 + percent) <= (n[close] + n[i]) * (100 - percent)
            out[close[near]] = True
            out[i] |= near.any()
    back = np.empty(len(n), bool)
    back[order] = out
    return back


def blockwise(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int, int], pa.Table]]:
    """(block, i, j) and its rows, for batches sorted by those; blocks of one row are left out. Rows stay in Arrow."""
    held: list[pa.RecordBatch] = []
    key: tuple[int, int, int] | None = None
    for b in batches:
        places = np.stack([b.column(c).to_numpy() for c in ("block", "i", "j")], 1)
        first = np.flatnonzero(np.append(True, (places[1:] != places[:-1]).any(1))) if len(places) else []
        for begin, end in zip(first, [*first[1:], len(places)]):
            if (mine := tuple(places[begin].tolist())) != key:
                if sum(map(len, held)) > 1:
                    yield key, pa.Table.from_batches(held)
                key, held = mine, []
            held.append(b.slice(begin, end - begin))
    if sum(map(len, held)) > 1:
        yield key, pa.Table.from_batches(held)


class Forest:
    """Components of a block's documents, by labels at first."""

    def __init__(self, label: np.ndarray):
        _, self.root = np.unique(label, return_inverse=True)
        order = np.argsort(self.root, kind="stable")
        first, length = groups_of(self.root[order])
        self.members = [[order[a : a + n]] for a, n in zip(first.tolist(), length.tolist())]
        self.size = length.copy()

    def join(self, a: int, b: int) -> None:
        """The smaller component gets the larger one's number."""
        x, y = self.root[a], self.root[b]
        if self.size[x] < self.size[y]:
            x, y = y, x
        if x != y:
            for part in self.members[y]:
                self.root[part] = x
            self.members[x] += self.members[y]
            self.size[x] += self.size[y]


def search(sets: list[np.ndarray], percent: int, group: Group) -> np.ndarray:
    """The component of each set, by labels and links between them; numbers mean nothing else."""
    order = np.argsort([len(s) for s in sets], kind="stable")
    sets, group = [sets[i] for i in order], group[order]
    n = np.array([len(s) for s in sets])
    codes = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), n)
    by = np.argsort(codes, kind="stable")  # owners ascend within a list
    first, length = groups_of(codes[by])
    posts = owner[by]
    list_of = np.empty(len(codes), np.int64)
    list_of[by] = np.repeat(np.arange(len(first)), length)
    bound = np.concatenate([[0], np.cumsum(n)])
    forest = Forest(group.label)
    for q in range(1, len(sets)):
        if not n[q]:
            continue
        need = -(-percent * n[q] // 100)
        mine = list_of[bound[q] : bound[q + 1]]
        mine = mine[length[mine] > 1]
        if len(mine) < need:
            continue
        smallest = int(np.searchsorted(n, need))
        size = length[mine]
        mine = mine[np.argsort(size, kind="stable")]
        # the longest lists are probed, the others merged
        longs = min(need - 1, int(need / (MU * np.log2(size.max()) + 1)))
        short, probed = mine[: len(mine) - longs], mine[len(mine) - longs :]
        merged = np.sort(np.concatenate([posts[first[i] : first[i] + length[i]] for i in short]), kind="stable")
        at, times = groups_of(merged)
        who = merged[at]
        ok = (who < q) & (who >= smallest) & (times >= need - longs)
        who, times = who[ok], times[ok]
        ok = group.open(who, q) & (forest.root[who] != forest.root[q])
        who, times = who[ok], times[ok]
        if not len(who):
            continue
        # |A and B| >= t/(1 + t) * (|A| + |B|)
        wanted = -(-percent * (n[who] + n[q]) // (100 + percent))
        for left, i in zip(range(longs, 0, -1), probed[::-1]):
            ok = times + left >= wanted
            if not ok.all():
                who, times, wanted = who[ok], times[ok], wanted[ok]
                if not len(who):
                    break
            ends = posts[first[i] : first[i] + length[i]]
            place = np.searchsorted(ends, who)
            times = times + (ends[np.minimum(place, len(ends) - 1)] == who)
        for c in who[times >= wanted].tolist():
            forest.join(q, c)
    out = np.empty(len(order), np.int64)
    out[order] = forest.root
    return out


def _routed(texts: DataFrame, k: int, percent: int, buckets: int) -> DataFrame:
    """One table of kinds: size (a: doc, b: set size, bits: its parities), same (a and b: copies), local (a: doc, b: its hub), signature (bucket, sigs, hubs)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(kind, a=None, b=None, bucket=None, sigs=None, hubs=None, bits=None):
            m = len(a if a is not None else bucket)
            none = [None] * m
            long = lambda x: pa.array(none if x is None else x, pa.int64())
            binary = lambda x: pa.array(none if x is None else x, pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([kind] * m, pa.string()), long(a), long(b), long(bucket), binary(sigs), binary(hubs), binary(bits)], ["kind", "a", "b", "bucket", "sigs", "hubs", "bits"])

        for ids, words, n in chunks(batches, CHUNK_BYTES, lower=True):
            codes, n = gram_sets(words, n, k)
            del words
            yield batch("size", ids, n, bits=parities(codes, n))
            doc = np.array([-1 if i is None else i for i in ids], np.int64)
            row = np.repeat(np.arange(len(n)), n)
            spread = mix(codes)
            keys = [np.bincount(row, h.astype(np.float64), len(n)) for h in (spread & np.uint64(0xFFFFFFFF), spread >> np.uint64(32), codes & np.uint64(0xFFFFFFFF))]
            # exact copies: the smallest id stands for all
            order = np.lexsort((doc, *keys, n))
            order = order[(n[order] > 0) & np.array([ids[i] is not None for i in order.tolist()], bool)]
            if not len(order):
                continue
            new = np.ones(len(order), bool)
            new[1:] = n[order[1:]] != n[order[:-1]]
            for x in keys:
                new[1:] |= x[order[1:]] != x[order[:-1]]
            head = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
            copies = doc[order] != doc[head]
            if copies.any():
                yield batch("same", doc[order[copies]], doc[head[copies]])
            rep = np.zeros(len(n), bool)
            rep[order[new]] = True
            sig, owner = signatures(codes[rep[row]], np.where(rep, n, 0), percent)
            by = np.lexsort((doc[owner], sig))
            sig, who = sig[by], doc[owner[by]]
            first, length = groups_of(sig)
            crowded = np.repeat(length > CROWD, length)
            hub = np.where(crowded, np.repeat(who[first], length), who)
            away = who != hub
            if away.any():
                pair = np.unique(np.stack([who[away], hub[away]], 1), axis=0)
                yield batch("local", pair[:, 0], pair[:, 1])
            sig, hub = sig[~away], hub[~away]
            bucket = (sig % np.uint64(buckets)).astype(np.int64)
            short = (sig >> np.uint64(32)).astype("<u4")
            by = np.lexsort((hub, bucket))
            at, size = groups_of(bucket[by])
            yield batch("signature", bucket=bucket[by][at], sigs=[pack(short[by[i : i + j]]) for i, j in zip(at, size)], hubs=[pack(hub[by[i : i + j]]) for i, j in zip(at, size)])

    return texts.mapInArrow(task, "kind string, a long, b long, bucket long, sigs binary, hubs binary, bits binary")


def _met(routed: DataFrame) -> DataFrame:
    """(hub, block): hubs of different chunks that share a signature with a smaller one, and the smallest of them."""
    import pandas as pd

    def bucket(g: pd.DataFrame) -> pd.DataFrame:
        sig, hub = np.frombuffer(b"".join(g["sigs"]), "<u4"), np.frombuffer(b"".join(g["hubs"]), np.int64)
        # most signatures stand once: only the others are worth copies
        order = np.argsort(sig, kind="stable")
        same = sig[order[1:]] == sig[order[:-1]]
        order = order[np.append(same, False) | np.insert(same, 0, False)] if len(order) else order
        sig, hub = sig[order], hub[order]
        order = np.lexsort((hub, sig))
        sig, hub = sig[order], hub[order]
        first, length = groups_of(sig)
        block = np.repeat(hub[first], length)
        pair = np.unique(np.stack([hub[hub != block], block[hub != block]], 1), axis=0)
        return pd.DataFrame({"hub": pair[:, 0], "block": pair[:, 1]})

    return routed.where("kind = 'signature'").select("bucket", "sigs", "hubs").groupBy("bucket").applyInPandas(bucket, "hub long, block long").distinct()


def links(docs: DataFrame, routed: DataFrame, k: int, percent: int) -> DataFrame:
    """(a, b): links enough to connect every component. docs: doc_id, text (binary)."""
    local = routed.where("kind = 'local'").select(F.col("a").alias("doc_id"), F.col("b").alias("hub")).distinct()
    met = written(_met(routed), "met")
    follows = local.join(met, "hub").select("doc_id", "block")
    blocks = (
        local.select("doc_id", F.col("hub").alias("block"))
        .unionByName(local.select(F.col("hub").alias("doc_id"), F.col("hub").alias("block")))
        .unionByName(follows)
        .unionByName(met.select(F.col("hub").alias("doc_id"), "block"))
        .unionByName(met.select(F.col("block").alias("doc_id"), "block"))
        .distinct()
    )
    size = routed.where("kind = 'size'").groupBy(F.col("a").alias("doc_id")).agg(F.sum("b").alias("n"))
    blocks = written(blocks.join(size, "doc_id"), "blocks")
    home = blocks.groupBy("doc_id").agg(F.min("block").alias("block"), F.first("n").alias("n"))
    once = written(compared(docs, routed, home.select("*", F.col("doc_id").alias("label"), F.lit(False).alias("home")), k, percent), "round")
    label = once.groupBy(F.col("a").alias("doc_id")).agg(F.min("b").alias("label"))
    known = home.select("doc_id", F.col("block").alias("first")).join(label, "doc_id", "left")
    again = blocks.join(known, "doc_id").select("doc_id", "block", "n", F.coalesce("label", "doc_id").alias("label"), (F.col("block") == F.col("first")).alias("home"))
    return once.unionByName(compared(docs, routed, again, k, percent))


def compared(docs: DataFrame, routed: DataFrame, members: DataFrame, k: int, percent: int) -> DataFrame:
    """(a, b): a label and a smaller one that it is connected with. members: doc_id, block, n, label, home."""
    parts = members.groupBy("block").agg(F.count("*").alias("docs"), F.ceil(F.sum("n") / PART_GRAMS).cast("int").alias("parts"), F.min("label").alias("least"), F.max("label").alias("most"))
    # read back, so that the join may split a block that is large
    parts = written(parts.where("docs > 1 AND least < most").select("block", "parts"), "parts")
    placed = members.join(parts, "block").withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int"))
    # in a block of several parts, part i meets part j in task (i, j)
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    tasks = placed.select("doc_id", "block", "label", "home", "part", other).select("doc_id", "block", "label", "home", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part")
    bits = routed.where("kind = 'size'").select(F.col("a").alias("doc_id"), F.col("b").alias("n"), "bits")

    def group(key: tuple, held: pa.Table) -> Group:
        return Group(held["part"].to_numpy() if key[1] != key[2] else None, held["label"].to_numpy(), held["home"].to_numpy())

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, held in blockwise(batches):
            stay = may_link(held["bits"].to_pylist(), held["n"].to_numpy(), percent, group(key, held))
            if stay.any():
                names = ["block", "i", "j", "part", "label", "home", "doc_id"]
                long = pa.schema([(c, pa.bool_() if c == "home" else pa.int64()) for c in names])
                yield from held.select(names).filter(pa.array(stay)).cast(long).to_batches()
        tidy()

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = byte_table()
        for key, held in blockwise(batches):
            codes, n = gram_sets(*split(translated(pa.concat_arrays(held["text"].chunks), table)), k)
            ends = np.cumsum(n)
            known = group(key, held)
            component = search([codes[a:b] for a, b in zip((ends - n).tolist(), ends.tolist())], percent, known)
            least = np.full(component.max() + 1, 2**63 - 1)
            np.minimum.at(least, component, known.label)
            pairs = np.stack([known.label, least[component]], 1)
            pairs = np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0)
            if len(pairs):
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])
        tidy()

    in_blocks = lambda df: df.repartition("block", "i", "j").sortWithinPartitions("block", "i", "j", "doc_id")
    some = in_blocks(bits.join(tasks.hint("shuffle_hash"), "doc_id")).mapInArrow(likely, "block long, i long, j long, part long, label long, home boolean, doc_id long").distinct()
    # one strategy at every size: texts are dealt by id, and the small side is hashed
    rows = docs.join(some.hint("shuffle_hash"), "doc_id").select("block", "i", "j", "part", "label", "home", "doc_id", "text")
    return in_blocks(rows).mapInArrow(found, "a long, b long")


def ngram_join(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row."""
    spark = docs.sparkSession
    ship_package(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    # a pair that shares many signatures is found once a bucket, so there are no more of them than bytes ask for
    buckets = buckets_for(texts, BUCKET_BYTES, least=8)
    # a batch of whole texts stands in the JVM and in a worker; all jobs with Python in them end in here
    with batches_of(spark, TEXT_ROWS):
        routed = written(_routed(texts, k, percent, buckets), "ngrams")
        edges = links(texts, routed, k, percent).unionByName(routed.where("kind = 'same'").select("a", "b"))
        component = connected_components(edges)
    return (
        routed.where("kind = 'size'")
        .select(F.col("a").alias("doc_id"), F.col("b").alias("n_shingles"))
        .join(component, F.col("doc_id") == F.col("node"), "left")
        .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    )


def keep_first(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, that are first in their component: by id, null ids last, then by the row's code."""
    docs, name, back = renamed(docs)
    id_col, text_col = name[id_col], name[text_col]
    row = F.xxhash64(F.col(id_col), F.col(text_col))
    named = docs.select(row.alias("__row"), F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    nodes = ngram_join(named, k, percent, "__row", "__text").select(F.col("doc_id").alias("__row"), "component_id")
    order = F.struct(F.col("__id").isNull().alias("none"), "__id", "__row")
    stay = nodes.join(named.select("__row", "__id").distinct(), "__row").groupBy("component_id").agg(F.min(order)["__row"].alias("__stays")).select("__stays")
    return back(docs.join(stay, row == F.col("__stays"), "left_semi"))
