"""Exact deduplication by content hash, with a comparison of bytes inside groups. DataFrame functions only.

1. Digests travel first: rows are counted by 128-bit hash, copies collapsing in each task before the shuffle.
2. Texts of hashes that several rows share follow, grouped by hash and text: the grouping compares bytes, so two texts
   with one hash stay two groups, and copies collapse in each task again, however large a group is. Which texts those are
   tells a bitmap of MARKS bits, whatever the table's size; a lone text whose hash falls on a mark only travels for nothing.
3. Groups of several rows go back to the rows by two digests of the text (128 and 256 bits), without the text; should one
   pair of digests ever stand for two texts, the query raises an error instead of joining them. Rows of no group stay.

Null texts count as empty, texts of any length are compared whole. Rows that repeat both the id and the text form one
group and share the decision; a filter keeps one of them. A null id is nobody's: it stands for a group only where no row
of the text has an id, and equal rows without an id count as repeated. An empty table gives an empty result. Other columns
don't matter, whatever their names; keep_one keeps them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import renamed, written

#: Bits that mark hashes of several rows, 8 MB of them.
MARKS = 1 << 26


def _digests(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), F.md5(text).alias("hash128"), F.sha2(text, 256).alias("text_sha256"), text.alias("text"))


def _bitmaps(texts: DataFrame) -> DataFrame:
    """(__number, __bits): marks of the hashes that several rows have, in bitmaps that have MARKS bits together."""
    mark = _mark("hash128")
    several = texts.groupBy("hash128").agg(F.count("*").alias("n")).where("n > 1").select(mark.alias("mark"))
    return written(several.groupBy(F.bitmap_bucket_number("mark").alias("__number")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("mark")).alias("__bits")), "marks")


def _mark(hash_col: str) -> Column:
    return F.pmod(F.xxhash64(hash_col), F.lit(MARKS)) + 1


def _marked(rows: DataFrame, bitmaps: DataFrame, hash_col: str = "hash128") -> DataFrame:
    """rows and __shared: false for those whose hash surely no other row has. Nothing is shuffled."""
    at = F.bitmap_bit_position(_mark(hash_col))
    byte = F.conv(F.hex(F.substring("__bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    shared = F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))
    # MARKS bits at most
    return rows.join(F.broadcast(bitmaps), F.bitmap_bucket_number(_mark(hash_col)) == F.col("__number"), "left").withColumn("__shared", shared).drop("__number", "__bits")


def groups(docs: DataFrame, keep: str = "smallest", id_col: str = "doc_id", text_col: str = "text", bitmaps: DataFrame | None = None) -> DataFrame:
    """(hash128, text_sha256, keep_id, group_size): one row for each text that several rows have, and for texts that are marked like those."""
    pick = {"smallest": F.min, "largest": F.max}[keep]
    rows = _digests(docs, id_col, text_col)
    by_text = _marked(rows, bitmaps or _bitmaps(rows)).where("__shared").groupBy("hash128", "text").agg(F.first("text_sha256").alias("text_sha256"), pick("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    slim = by_text.select("hash128", "text_sha256", "keep_id", "group_size")
    one = F.when(F.count("*") > 1, F.raise_error(F.lit("two texts share both digests")).cast("int")).otherwise(F.lit(1))
    checked = slim.groupBy("hash128", "text_sha256").agg(F.first("keep_id").alias("keep_id"), F.first("group_size").alias("group_size"), one.alias("texts")).where("texts = 1").drop("texts")
    # read back, so that joins with it may split a text of many rows
    return written(checked, "copies")


def exact_dedup(docs: DataFrame, keep: str = "smallest", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row; of equal texts the smallest (or largest) id stays."""
    rows = _digests(docs, id_col, text_col).select("doc_id", "hash128", "text_sha256")
    out = rows.join(groups(docs, keep, id_col, text_col), ["hash128", "text_sha256"], "left")
    alone = F.col("group_size").isNull()
    keep_id = F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id"))
    kept: Column = F.col("doc_id").eqNullSafe(keep_id)
    return out.select("doc_id", keep_id.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), kept.alias("kept"), "text_sha256")


def keep_one(docs: DataFrame, keep: str = "smallest", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, that exact_dedup keeps; rows that repeat id and text stay once.

    Rows whose hash no other row has stay where they are.
    """
    docs, name, back = renamed(docs)
    id_col, text_col = name[id_col], name[text_col]
    text = F.coalesce(F.col(text_col), F.lit(""))
    hash_, sha, mine, kept = "__hash", "__sha", "__id", "__keep"
    bitmaps = _bitmaps(_digests(docs, id_col, text_col))
    rows = _marked(docs.withColumn(hash_, F.md5(text)), bitmaps, hash_)
    g = groups(docs, keep, id_col, text_col, bitmaps).select(F.col("hash128").alias("g_hash"), F.col("text_sha256").alias("g_sha"), F.col("keep_id").alias(kept))
    again = rows.where("__shared").withColumns({sha: F.sha2(text, 256), mine: F.col(id_col)})
    # the id is part of the key: it spreads the rows of one text
    again = again.join(g, (F.col(hash_) == F.col("g_hash")) & (F.col(sha) == F.col("g_sha")) & F.col(mine).eqNullSafe(F.col(kept)), "left_semi").dropDuplicates([hash_, sha, mine])
    return back(rows.where("NOT __shared")).unionByName(back(again))
