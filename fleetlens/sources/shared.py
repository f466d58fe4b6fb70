"""What the driver and all executors share: a folder, and this package."""

from __future__ import annotations

import tempfile
import time
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a local session gets a folder of its own, and others an error."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def ship_package(spark: SparkSession) -> None:
    """Lets Python workers import this package wherever the driver was started; on a cluster it lies at the driver's path on every executor."""
    env, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = f"{root}:{env['PYTHONPATH']}" if env.get("PYTHONPATH") else root


def new_folder(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing else uses."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written_once(df: DataFrame, name: str) -> DataFrame:
    """df as Parquet in the shared folder, for plans that read it more than once."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written_in_order(df: DataFrame, by: str, files: int, path: str, after: DataFrame) -> None:
    """df as at most `files` Parquet files, each with a range of `by`, then `after`; files' times follow that order, as streams read them.

    One job writes all ranges; their times are set behind it. Rows of one value of `by` lie in one file. Folders that don't
    keep a file's time are an error, since a stream would read the ranges in any order.
    """
    spark = df.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    parts: list[str] = []
    for rows in (df.repartitionByRange(files, by).drop(by), after):
        rows.write.mode("append").parquet(path)
        new = [name for s in fs.listStatus(folder) if (name := s.getPath().getName()).startswith("part-") and name not in parts]
        parts += sorted(new, key=lambda name: int(name.split("-")[1]))
    begin = int(time.time()) - len(parts)
    for i, name in enumerate(parts):
        place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
        fs.setTimes(place, (begin + i) * 1000, -1)
        if fs.getFileStatus(place).getModificationTime() != (begin + i) * 1000:
            raise OSError(f"the time of {place} could not be set")
