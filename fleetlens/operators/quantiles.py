"""Quantiles of whole columns without a task that holds a column.

Exact: values are counted (equal ones meet before the shuffle), a mergeable sketch of each group's distinct values gives
split points, and every counted value knows its bucket by them. Sums over buckets tell which bucket holds a wanted rank;
only those buckets are sorted, each by itself. Between two ranks values are interpolated, as SQL's quantile_cont does.
Split points decide how even the buckets are, never the result.

Approximate: the sketch alone, one pass, with an error in rank of at most 1 / accuracy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.operators.joins import beside
from fleetlens.sources.shared import written_once

BUCKETS = 64


def quantiles(df: DataFrame, by: list[str], value: Column, probabilities: list[float], buckets: int = BUCKETS) -> DataFrame:
    """(by..., q): q has the value at each probability; groups without values don't appear."""
    counted = df.select(*by, value.cast("double").alias("__v")).where("__v IS NOT NULL").groupBy(*by, "__v").agg(F.count("*").alias("__n"))
    counted = written_once(counted, "counted")
    # a few numbers for each group; read back, so that their size is known where joins are planned
    splits = written_once(counted.groupBy(*by).agg(F.percentile_approx("__v", [i / buckets for i in range(1, buckets)], 10 * buckets).alias("__splits")), "splits")
    placed = beside(counted, splits, by).withColumn("__bucket", F.size(F.filter("__splits", lambda s: s < F.col("__v")))).drop("__splits")
    sums = placed.groupBy(*by, "__bucket").agg(F.sum("__n").alias("__c"))
    w = Window.partitionBy(*by)
    sums = sums.withColumns({"__before": F.coalesce(F.sum("__c").over(w.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "__all": F.sum("__c").over(w)})
    places = F.array(*(F.struct(F.lit(i).alias("i"), (F.lit(p) * (F.col("__all") - 1)).alias("at")) for i, p in enumerate(probabilities)))
    inside = lambda r: (r >= F.col("__before")) & (r < F.col("__before") + F.col("__c"))
    wanted = sums.withColumn("__ranks", F.filter(places, lambda x: inside(F.floor(x["at"])) | inside(F.ceil(x["at"])))).where(F.size("__ranks") > 0)
    wanted = written_once(wanted.select(*by, "__bucket", "__before", "__ranks"), "wanted")
    near = beside(placed, wanted, [*by, "__bucket"])
    upto = F.sum("__n").over(Window.partitionBy(*by, "__bucket").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)) + F.col("__before")
    near = near.withColumn("__upto", upto).withColumn("__x", F.explode("__ranks")).select(*by, "__v", F.col("__x.i").alias("__i"), F.col("__x.at").alias("__at"), "__upto", (F.col("__upto") - F.col("__n")).alias("__from"))
    holds = lambda r: (r >= F.col("__from")) & (r < F.col("__upto"))
    low, high = F.max(F.when(holds(F.floor("__at")), F.col("__v"))), F.max(F.when(holds(F.ceil("__at")), F.col("__v")))
    share = F.first("__at") - F.floor(F.first("__at"))
    found = near.groupBy(*by, "__i").agg(low.alias("__low"), high.alias("__high"), share.alias("__share"))
    found = found.withColumn("__q", F.when(F.col("__low") == F.col("__high"), F.col("__low")).otherwise(F.col("__low") * (1 - F.col("__share")) + F.col("__high") * F.col("__share")))
    return found.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("__i", "__q"))), lambda x: x["__q"]).alias("q"))


def approximate_quantiles(df: DataFrame, by: list[str], value: Column, probabilities: list[float], accuracy: int = 10_000) -> DataFrame:
    """(by..., q) by a sketch: values of the column whose rank is off by at most 1 / accuracy of the rows."""
    return df.groupBy(*by).agg(F.percentile_approx(value.cast("double"), probabilities, accuracy).alias("q")).where("q IS NOT NULL")


def with_quantiles(aggregated: DataFrame, df: DataFrame, by: list[str], value: Column, probabilities: list[float], out: str = "q") -> DataFrame:
    """aggregated (a row for each group of df) and the quantiles of a value; null where a group has no values."""
    return beside(aggregated, quantiles(df, by, value, probabilities).withColumnRenamed("q", out), by, "left")
