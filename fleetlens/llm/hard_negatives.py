"""Hard negatives: rows of another label that score nearly as high for an anchor as its positives do.

Rows lie in a multiway tree of split points (GNAT): a row belongs to the split point nearest to it, level by level. Each
split point stores, for the subtree of every sibling and its own, the least and the largest distance of its rows. A
search asks for the rows at some distance of the anchor (its window, an annulus). By the triangle inequality these lie
within some distance of each split point too, and a subtree whose stored range does not meet that is left out. In leaves
that remain, every score is computed.

Distances are angles: rows get one more component that makes them equally long, so that an anchor's score alone
decides its angle to a row. Split points come from at most `SAMPLE` rows (by the hash of their ids); all rows are in the
leaves. Leaves are gathered in parts of about `PART_ROWS` rows; a leaf with more is dealt out to several parts. An anchor
travels to those parts alone that hold a leaf it can't leave out. It first searches the part of its own leaf; what it finds there
narrows its windows before the others.

Rows without an id, a label or a vector, or with a component that is null or not finite, take no part. Vectors of
different lengths are filled up with zeros. Rows that repeat an id all count; other rows of an anchor means rows of other
ids. An anchor id that stands on several rows gives the results of each. A positive that two rows of an id make, makes
its negatives twice. An anchor of zeros scores 0 with all rows; then ids decide. Positives of a score below 0 have no
negatives, as no score lies between 30 and 90 percent of it. Empty tables give no rows. Extra columns don't matter.
Scores are meant to fit 64 bits; where they may pass 2^53, integers are multiplied instead of doubles and no subtree is left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm.common import ship_package, written
from fleetlens.llm.wordcodes import groups_of

#: Rows that split points are chosen from.
SAMPLE = 4096
#: Split points of a node, rows of a leaf that is not split again, levels at most.
FAN, LEAF_ROWS, LEVELS = 12, 1024, 3
#: Rows of a part, and searches that are compared with it at once.
PART_ROWS, BATCH = 16_384, 256
#: What distances may be wrong by.
SLACK = 1e-6
NEVER, ALWAYS = -(1 << 62), 1 << 62


class Node(NamedTuple):
    points: np.ndarray  # one more component than rows have
    children: list[int]  # of each split point: the node below, or -1 - leaf


class Tree(NamedTuple):
    nodes: list[Node]
    leaves: int
    dims: int
    length: float  # of every row with its last component
    exact: bool  # doubles hold every score


def build_tree(sample: np.ndarray, n_rows: int, length: float, exact: bool, fan: int, leaf_rows: int, levels: int) -> Tree:
    """Split points by farthest choice, each as far as can be from those before."""
    dims, nodes, leaves = sample.shape[1], [], 0
    lifted = lift(sample, length)

    def split(at: np.ndarray, rows: float, level: int) -> int:
        nonlocal leaves
        if level == levels or rows <= leaf_rows or len(at) < 2 * fan:
            leaves += 1
            return -leaves
        chosen, nearest = [int(at[0])], angles(lifted[at], lifted[at[:1]], length, length)[:, 0]
        while len(chosen) < fan and nearest.max() > SLACK:
            far = int(nearest.argmax())
            chosen.append(int(at[far]))
            nearest = np.minimum(nearest, angles(lifted[at], lifted[at[far : far + 1]], length, length)[:, 0])
        if len(chosen) == 1:
            leaves += 1
            return -leaves
        k = len(nodes)
        nodes.append(Node(lifted[chosen], []))
        own = angles(lifted[at], lifted[chosen], length, length).argmin(1)
        for i in range(len(chosen)):
            nodes[k].children.append(split(at[own == i], rows * np.mean(own == i), level + 1))
        return k

    if len(sample):
        split(np.arange(len(sample)), n_rows, 0)
    return Tree(nodes, max(leaves, 1), dims, length, exact)


def lift(rows: np.ndarray, length: float) -> np.ndarray:
    """Rows with one more component, so that all are `length` long."""
    rest = np.maximum(length**2 - np.einsum("ij,ij->i", rows, rows), 0)
    return np.column_stack([rows, np.sqrt(rest)])


def angles(a: np.ndarray, b: np.ndarray, a_length: float | np.ndarray, b_length: float) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T / (np.asarray(a_length).reshape(-1, 1) * b_length), -1, 1))


def matrix(vectors: pa.Array, dims: int, kind: type) -> np.ndarray:
    """Lists of integers as rows, filled up with zeros."""
    ends = vectors.offsets.to_numpy().astype(np.int64)
    size = np.diff(ends)
    out = np.zeros((len(vectors), dims), kind)
    out[np.repeat(np.arange(len(size)), size), np.arange(ends[-1] - ends[0]) - np.repeat(ends[:-1] - ends[0], size)] = vectors.flatten().to_numpy(zero_copy_only=False)
    return out


def leaves_of(tree: Tree, rows: np.ndarray) -> np.ndarray:
    """The leaf of each row."""
    leaf = np.zeros(len(rows), np.int64)
    if tree.nodes:
        lifted = lift(rows, tree.length)
        stack = [(0, np.arange(len(rows)))]
        while stack:
            k, at = stack.pop()
            own = angles(lifted[at], tree.nodes[k].points, tree.length, tree.length).argmin(1)
            for i, child in enumerate(tree.nodes[k].children):
                if child < 0:
                    leaf[at[own == i]] = -1 - child
                elif (own == i).any():
                    stack.append((child, at[own == i]))
    return leaf


def path_to(tree: Tree) -> list[list[tuple[int, int]]]:
    """(node, split point) from the root down to each leaf."""
    out: list[list[tuple[int, int]]] = [[] for _ in range(tree.leaves)]

    def walk(k: int, path: list[tuple[int, int]]) -> None:
        for i, child in enumerate(tree.nodes[k].children):
            if child < 0:
                out[-1 - child] = [*path, (k, i)]
            else:
                walk(child, [*path, (k, i)])

    if tree.nodes:
        walk(0, [])
    return out


def ranges_in(tree: Tree, rows: np.ndarray, leaf: np.ndarray) -> list[tuple[int, int, int, float, float]]:
    """(node, split point, subtree, least, largest distance) of these rows."""
    out, lifted = [], lift(rows, tree.length)
    paths = path_to(tree)
    under: dict[tuple[int, int], list[int]] = {}
    for n, path in enumerate(paths):
        for step in path:
            under.setdefault(step, []).append(n)
    for (k, j), below in under.items():
        at = np.flatnonzero(np.isin(leaf, below))
        if len(at):
            d = angles(lifted[at], tree.nodes[k].points, tree.length, tree.length)
            out += [(k, i, j, float(a), float(b)) for i, (a, b) in enumerate(zip(d.min(0), d.max(0)))]
    return out


class Router:
    """Leaves that searches can't leave out."""

    def __init__(self, tree: Tree, ranges: dict[tuple[int, int, int], tuple[float, float]]):
        self.tree, self.low, self.high = tree, [], []
        for k, node in enumerate(tree.nodes):
            n = len(node.children)
            # a subtree without rows has no range, and nothing is in it
            self.low.append(np.array([[ranges.get((k, i, j), (9.0, -9.0))[0] for j in range(n)] for i in range(n)]) - SLACK)
            self.high.append(np.array([[ranges.get((k, i, j), (9.0, -9.0))[1] for j in range(n)] for i in range(n)]) + SLACK)

    def meets(self, anchors: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
        """For each search and leaf: may the leaf hold rows that score from least to most?"""
        tree = self.tree
        out = np.zeros((len(anchors), tree.leaves), bool)
        size = np.sqrt(np.einsum("ij,ij->i", anchors, anchors))
        if not tree.nodes or not tree.exact:
            out[:] = True
            return out
        flat = size == 0
        out[flat] = True
        scale = np.where(flat, 1, size) * tree.length
        near, far = np.arccos(np.clip(most / scale, -1, 1)) - SLACK, np.arccos(np.clip(least / scale, -1, 1)) + SLACK
        lifted = np.column_stack([anchors, np.zeros(len(anchors))])
        stack = [(0, np.flatnonzero(~flat))]
        while stack:
            k, at = stack.pop()
            d = angles(lifted[at], tree.nodes[k].points, np.where(flat, 1, size)[at], tree.length)
            lo = np.maximum(0, np.maximum(d - far[at, None], near[at, None] - d))
            hi = np.minimum(np.pi, np.minimum(d + far[at, None], 2 * np.pi - d - near[at, None]))
            for j, child in enumerate(tree.nodes[k].children):
                open_ = ((self.low[k][:, j] <= hi) & (lo <= self.high[k][:, j])).all(1)
                if child < 0:
                    out[at[open_], -1 - child] = True
                elif open_.any():
                    stack.append((child, at[open_]))
        return out


def compared(rows: pa.Table, searches: pa.Table, router: Router, same: bool, k: int) -> pa.Table:
    """The k best rows of a part for each search: the score lies in its window, the label is the anchor's (same) or another."""
    tree = router.tree
    kind = np.float64 if tree.exact else np.int64
    one = lambda t, c: t[c].combine_chunks() if isinstance(t[c], pa.ChunkedArray) else t[c]
    ids, labels, leaf = (one(rows, c).to_numpy() for c in ("vec_id", "label", "leaf"))
    # leaf by leaf, in a leaf by id: equal scores then stand in the order of ids once they are sorted
    order = np.lexsort((ids, leaf))
    ids, labels, leaf = ids[order], labels[order], leaf[order]
    x = matrix(one(rows, "v"), tree.dims, kind)[order]
    first, size = groups_of(leaf)
    key, anchor, label, least, most = (one(searches, c).to_numpy() for c in ("key", "vec_id", "label", "least", "most"))
    a = matrix(one(searches, "v"), tree.dims, kind)
    found: list[tuple[np.ndarray, ...]] = []
    for begin in range(0, len(key), BATCH):
        at = slice(begin, begin + BATCH)
        needed = router.meets(a[at].astype(np.float64), least[at], most[at])
        for f, n in zip(first.tolist(), size.tolist()):
            q = np.flatnonzero(needed[:, leaf[f]]) + begin
            if not len(q):
                continue
            score = a[q] @ x[f : f + n].T
            good = (score >= least[q, None]) & (score <= most[q, None]) & ((labels[f : f + n] == label[q, None]) == same) & (ids[f : f + n] != anchor[q, None])
            s, r = np.nonzero(good)
            value = score[s, r].astype(np.int64)
            by = np.lexsort((ids[f + r], -value, s))
            s, r, value = s[by], r[by], value[by]
            g, m = groups_of(s)
            keep = np.arange(len(s)) - np.repeat(g, m) < k
            found.append((key[q[s[keep]]], ids[f + r[keep]], value[keep]))
    cols = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, np.int64)] * 3
    # of all leaves of the part
    by = np.lexsort((cols[1], -cols[2], cols[0]))
    cols = [c[by] for c in cols]
    g, m = groups_of(cols[0])
    keep = np.arange(len(by)) - np.repeat(g, m) < k
    return pa.table({"key": cols[0][keep], "found_id": cols[1][keep], "score": cols[2][keep]})


class Forest(NamedTuple):
    """Rows in their leaves, and what routes searches to them."""

    rows: DataFrame  # vec_id, label, v, leaf, part
    router: Router
    parts: list[tuple[int, int]]  # of each leaf: first part, number of parts


def usable(df: DataFrame, id_col: str, label: Column, vec_col: str) -> DataFrame:
    """(vec_id, label, v): components become floor(256 * x)."""
    good = F.forall(vec_col, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False)))
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"), F.when(good, F.transform(vec_col, lambda x: F.floor(x.cast("double") * 256).cast("long"))).alias("v"))
    return rows.where("vec_id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL")


def plant(rows: DataFrame, sample: int = SAMPLE, fan: int = FAN, leaf_rows: int = LEAF_ROWS, levels: int = LEVELS, part_rows: int = PART_ROWS) -> Forest:
    """Builds the tree over a bounded sample, puts every row into its leaf and measures the ranges over every row."""
    wide = rows.select(F.size("v").alias("n"), F.array_max(F.transform("v", lambda c: F.abs(c))).alias("most"), F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double")).alias("square"))
    n, dims, most, square = wide.agg(F.count("*"), F.max("n"), F.max("most"), F.max("square")).first()
    dims, most = int(dims or 0), int(most or 0)
    exact = dims * most * most < 1 << 53
    chosen = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "label").limit(sample).select("v").toArrow()["v"].combine_chunks()
    tree = build_tree(matrix(chosen, dims, np.float64), n, max(1.0, float(square or 0) ** 0.5), exact, fan, leaf_rows, levels)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.append_column("leaf", pa.array(leaves_of(tree, matrix(b["v"], dims, np.float64))))

    rows = written(rows.mapInArrow(placed, "vec_id long, label long, v array<long>, leaf long"), "leaves")

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = ranges_in(tree, matrix(b["v"], dims, np.float64), b["leaf"].to_numpy())
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found)], names=["node", "point", "below", "low", "high"])

    # as many rows as the tree has pairs of siblings
    ranges = rows.select("v", "leaf").mapInArrow(measured, "node long, point long, below long, low double, high double").groupBy("node", "point", "below").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect()
    counts = {r.leaf: r.n for r in rows.groupBy("leaf").agg(F.count("*").alias("n")).collect()}
    parts, part, room = [], 0, part_rows
    for leaf in range(tree.leaves):
        m = counts.get(leaf, 0)
        if m > part_rows or m > room:
            part, room = part + (room < part_rows), part_rows
        slices = max(1, -(-m // part_rows))
        parts.append((part, slices))
        part, room = (part + slices, part_rows) if slices > 1 else (part, room - m)
    where = F.array(*(F.struct(F.lit(a).alias("first"), F.lit(b).alias("n")) for a, b in parts))
    own = F.get(where, F.col("leaf").cast("int"))
    rows = rows.withColumn("part", (own["first"] + F.pmod(F.xxhash64("vec_id"), own["n"])).cast("long"))
    return Forest(rows, Router(tree, {(r.node, r.point, r.below): (r.low, r.high) for r in ranges}), parts)


def nearest(forest: Forest, searches: DataFrame, same: bool, k: int) -> DataFrame:
    """(key, rank, found_id, score) for searches (key, vec_id, label, v, part, least, most), part being the anchor's own."""
    router, parts = forest.router, forest.parts
    columns, types = ["key", "vec_id", "label", "v", "least", "most", "part"], "key long, vec_id long, label long, v array<long>, least long, most long, part long"

    def one(rows, asked):
        return compared(rows, asked, router, same, k)

    def visit(routed: DataFrame) -> DataFrame:
        return forest.rows.groupBy("part").cogroup(routed.groupBy("part")).applyInArrow(one, "key long, found_id long, score long")

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((router.tree.leaves, max(a + n for a, n in parts)), bool)
        for leaf, (a, n) in enumerate(parts):
            held[leaf, a : a + n] = True
        for b in batches:
            needed = router.meets(matrix(b["v"], router.tree.dims, np.float64), b["least"].to_numpy(), b["most"].to_numpy())
            to = needed @ held
            to[np.arange(len(to)), b["part"].to_numpy()] = False
            q, p = np.nonzero(to)
            for i in range(0, len(q), 10_000):
                t = b.take(pa.array(q[i : i + 10_000]))
                yield t.set_column(6, "part", pa.array(p[i : i + 10_000]))

    at_home = written(visit(searches.select(columns)), "home")
    # the k-th best of the own part is to be reached elsewhere
    kth = at_home.groupBy("key").agg(F.count("*").alias("n"), F.min("score").alias("floor")).where(F.col("n") >= k)
    narrowed = searches.join(kth, "key", "left").withColumn("least", F.greatest("least", F.coalesce("floor", F.lit(NEVER)))).select(columns)
    away = visit(narrowed.mapInArrow(others, types))
    order = Window.partitionBy("key").orderBy(F.col("score").desc(), "found_id")
    return at_home.unionByName(away).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(df: DataFrame, label: Column, anchors: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, id_col: str = "vec_id", vec_col: str = "embedding", **tree: int) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    anchors is a condition on vec_id. Negatives have from low to high percent of the positive's score.
    """
    ship_package(df.sparkSession)
    forest = plant(usable(df, id_col, label, vec_col), **tree)
    asked = written(forest.rows.where(anchors).withColumn("key", F.monotonically_increasing_id()), "anchors")
    best = nearest(forest, asked.withColumns({"least": F.lit(NEVER), "most": F.lit(ALWAYS)}), True, positives)
    # one search for each anchor and positive
    pairs = asked.drop("leaf").join(best.select("key", F.col("rank").alias("place"), F.col("found_id").alias("positive_id"), F.col("score").alias("positive_score")), "key")
    pairs = written(pairs.withColumns({"anchor_key": F.col("key"), "key": F.col("key") * positives + F.col("place") - 1, "least": F.expr(f"CAST(ceil({low} * positive_score / 100BD) AS bigint)"), "most": F.expr(f"CAST(floor({high} * positive_score / 100BD) AS bigint)")}), "positives")
    hard = nearest(forest, pairs.where("least <= most"), False, negatives)
    out = hard.join(pairs.select("key", "vec_id", "positive_id", "positive_score"), "key")
    return out.select(F.col("vec_id").alias("anchor_id"), "positive_id", "rank", F.col("found_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def mine_embeddings(df: DataFrame) -> DataFrame:
    """Anchors are the rows whose id 100 divides; labels of ids that 7 divides are wrong by one."""
    wrong = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    return mine(df, wrong, F.col("vec_id") % 100 == 0)
