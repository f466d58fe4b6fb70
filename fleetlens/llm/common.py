"""Helpers shared by the text operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Characters that end a word where words are runs of non-blank text.
BLANKS = " \t\n\x0b\x0c\r"
#: Rows that Arrow hands to a Python worker at once.
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship_package(spark: SparkSession) -> None:
    """Lets Python workers import this package wherever the driver was started; on a cluster it lies at the driver's path on every executor."""
    env, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = f"{root}:{env['PYTHONPATH']}" if env.get("PYTHONPATH") else root


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs that run inside hand their rows to Python in batches of at most so many; the session's own setting comes back."""
    before = spark.conf.get(BATCH_ROWS)
    spark.conf.set(BATCH_ROWS, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(BATCH_ROWS, before)


def renamed(docs: DataFrame) -> tuple[DataFrame, dict[str, str], Callable[[DataFrame], DataFrame]]:
    """(docs with columns c0, c1, ..., the new name of each column, what gives the columns their names back).

    Operators that keep a table's columns work on these names, which none of their own clashes with.
    """
    names = docs.columns
    plain = {c: f"c{i}" for i, c in enumerate(names)}
    return docs.toDF(*plain.values()), plain, lambda df: df.select(*(F.col(plain[c]).alias(c) for c in names))


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z alone; a null text counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset, a local session gets one of its own, and others an error."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    known = sc._jsc.sc().getCheckpointDir()
    if not base and known.isDefined():
        base = known.get()
    if not base:
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    if known.isEmpty():
        sc.setCheckpointDir(base)
    return base


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back, so that later stages don't compute it again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    shared_dir(df.sparkSession)
    return df.checkpoint()


def buckets_for(texts: DataFrame, each: int, least: int | None = None, text_col: str = "text") -> int:
    """How many buckets hold about `each` bytes of the texts, and at least `least`, or so many as a shuffle has partitions."""
    total = texts.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    return max(least or int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // each))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(a, b) links -> (node, component), the smallest node that links reach; nodes without links don't appear.

    Alternates two star steps: every node hangs its larger neighbours, then its smaller ones, below its smallest
    neighbour. The edges stay linear in number, and the rounds are logarithmic in the longest path. Each round ends in
    the shared checkpoint folder, so that a lost executor costs one round.
    """
    e = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = checkpointed(e)

    def star(e: DataFrame, larger: bool) -> DataFrame:
        """Rehangs the neighbours of each node to the smallest of them and itself."""
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))) if larger else e
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        hung = both.join(low, "u")
        if larger:
            return hung.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        return hung.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u != v").distinct()

    last = None
    for _ in range(max_rounds):
        e = checkpointed(star(star(e, True), False))
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == last:
            break
        last = tuple(state)
    else:
        raise RuntimeError(f"links are still moving after {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
