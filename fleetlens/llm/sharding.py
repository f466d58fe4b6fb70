"""Shards along a Hilbert curve through metadata, for files that prune on several dimensions. DataFrame functions only.

Each dimension is quantised to 2^bits steps; the steps are one cell of a grid, and a Hilbert curve numbers the cells so
that neighbours on it are neighbours in every dimension. Rows in curve order are cut into runs: by rows (counts at most
one apart) or by bytes (sizes near equal).

The order needs no global sort: rows are counted by cell and by a hash slice of the id (so a cell with a third of all
rows is many groups), running sums over the counts give each slice its first place, and rows are numbered within their
slice. The grid has at most 2^(dims*bits) cells, so the sum over cells is small whatever the table's size.

Null texts have no bytes (size 8) and the checksum of the empty text; null metadata is a step of its own kind (hash of
null). Rows that repeat an id get places of their own, in the order of their checksums. An empty table gives no rows.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LAWS = ("rows", "bytes")


@lru_cache(8)
def hilbert_numbers(dims: int, bits: int) -> list[int]:
    """The curve index of each cell; a cell's code has its coordinates one after the other, first coordinate highest.

    Built outwards: a curve of one more bit is 2^dims copies in Gray-code order, each turned so that ends meet.
    """
    side, out = 1 << bits, [0] * (1 << dims * bits)
    for h in range(len(out)):
        # the index's bits, dealt to the coordinates, most significant first
        x = [0] * dims
        for k in range(dims * bits):
            x[k % dims] = x[k % dims] << 1 | h >> (dims * bits - 1 - k) & 1
        # Gray code of the dealt bits, then undo the turns from the lowest level up
        carry = x[-1] >> 1
        for i in range(dims - 1, 0, -1):
            x[i] ^= x[i - 1]
        x[0] ^= carry
        q = 2
        while q < side:
            for i in range(dims - 1, -1, -1):
                if x[i] & q:
                    x[0] ^= q - 1
                else:
                    t = (x[0] ^ x[i]) & (q - 1)
                    x[0] ^= t
                    x[i] ^= t
            q <<= 1
        code = 0
        for c in x:
            code = code << bits | c
        out[code] = h
    return out


def curve_index(coordinates: list[Column], bits: int) -> Column:
    """Curve index of quantised coordinates (0 to 2^bits - 1 each)."""
    code = F.lit(0)
    for c in coordinates:
        code = code * (1 << bits) + c
    table = F.array(*[F.lit(n) for n in hilbert_numbers(len(coordinates), bits)])
    return F.get(table, code.cast("int"))


def hash_step(column: Column, bits: int) -> Column:
    """Equal values, equal step: for names, where a file is pruned by equality."""
    return F.pmod(F.xxhash64(column), F.lit(1 << bits)).cast("int")


def log_step(value: Column, bits: int) -> Column:
    """Order-preserving: the power of two of a size."""
    return F.least(F.floor(F.log2(F.coalesce(value, F.lit(0)).cast("double") + 1)), F.lit((1 << bits) - 1)).cast("int")


def shard(docs: DataFrame, coordinates: list[Column], bits: int, shards: int = 24, law: str = "rows", slices: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, curve) for every row."""
    if law not in LAWS:
        raise ValueError(f"law is one of {LAWS}")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + F.lit(8)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        curve_index(coordinates, bits).alias("curve"),
        F.pmod(F.xxhash64(F.col(id_col), F.lit(1)), F.lit(slices)).cast("int").alias("slice"),
    )
    by_slice = rows.groupBy("curve", "slice").agg(F.count("*").alias("n"), F.sum("size").alias("b"))
    in_cell = Window.partitionBy("curve").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    by_cell = by_slice.groupBy("curve").agg(F.sum("n").alias("cell_n"), F.sum("b").alias("cell_b"))
    # one task, but never more rows than the grid has cells
    along = Window.orderBy("curve").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    cells = by_cell.select(
        "curve",
        F.coalesce(F.sum("cell_n").over(along), F.lit(0)).alias("n0"),
        F.coalesce(F.sum("cell_b").over(along), F.lit(0)).alias("b0"),
        F.sum("cell_n").over(whole).alias("all_n"),
        F.sum("cell_b").over(whole).alias("all_b"),
    )
    first = (
        by_slice.select("curve", "slice", F.coalesce(F.sum("n").over(in_cell), F.lit(0)).alias("n1"), F.coalesce(F.sum("b").over(in_cell), F.lit(0)).alias("b1"))
        .join(F.broadcast(cells), "curve")
        .select("curve", "slice", (F.col("n0") + F.col("n1")).alias("n_first"), (F.col("b0") + F.col("b1")).alias("b_first"), "all_n", "all_b")
    )
    in_slice = Window.partitionBy("curve", "slice").orderBy("doc_id", "text_crc32", "size")
    numbered = rows.select("*", (F.row_number().over(in_slice) - 1).cast("long").alias("k"), (F.sum("size").over(in_slice.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).alias("before")).join(first, ["curve", "slice"])
    place, start = F.col("n_first") + F.col("k"), F.col("b_first") + F.col("before")
    if law == "rows":
        # shard s has the places from ceil(s * n / shards): counts differ by one at most
        which = F.least(F.expr(f"(({shards}L * (n_first + k)) div all_n)"), F.lit(shards - 1)).cast("int")
        out = numbered.select("doc_id", "size", "text_crc32", which.alias("shard"), place.alias("place"), "all_n", "curve")
        begin = F.expr(f"((shard * all_n + {shards - 1}) div {shards})")
        return out.select("doc_id", "size", "text_crc32", F.lit(law).alias("law"), "shard", (F.col("place") - begin).cast("long").alias("slot"), "curve")
    # a row lies where its middle byte does
    which = F.least(F.expr(f"(({shards}L * (b_first + before) + {shards}L * size div 2) div all_b)"), F.lit(shards - 1)).cast("int")
    out = numbered.select("doc_id", "size", "text_crc32", which.alias("shard"), place.alias("place"), "curve")
    begin = out.groupBy("shard").agg(F.min("place").alias("begin"))
    return out.join(F.broadcast(begin), "shard").select("doc_id", "size", "text_crc32", F.lit(law).alias("law"), "shard", (F.col("place") - F.col("begin")).cast("long").alias("slot"), "curve")


def shard_documents(docs: DataFrame, shards: int = 24, law: str = "rows") -> DataFrame:
    """Documents by language, source and length, 16 steps each."""
    coordinates = [hash_step(F.col("lang"), 4), hash_step(F.col("source"), 4), log_step(F.octet_length(F.coalesce("text", F.lit(""))) / 16, 4)]
    return shard(docs, coordinates, 4, shards, law)
