"""Profiles of columns, gaps, coverage, and the reconciliation of two copies of a feed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.functions.student import t_column
from fleetlens.operators.quantiles import with_quantiles
from fleetlens.operators.timeseries import ID, SEQ, T
from fleetlens.operators.trips import rows_in_intervals


def long_form(df: DataFrame, columns: list[str], keep: list[str] = (), kind: str = "double") -> DataFrame:
    """(keep..., column, value), a row for each value."""
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast(kind).alias("value")) for c in columns)))
    return df.select(*keep, each.alias("x")).select(*keep, "x.column", "x.value")


def profile_categoricals(df: DataFrame, columns: list[str], top: int = 3, junk: tuple[str, ...] = ("", "na", "nan", "none", "null", "-")) -> DataFrame:
    """Per column: share of values, distinct ones, junk, and the commonest."""
    long = long_form(df, columns, kind="string").withColumn("value", F.trim("value"))
    bad = F.lower("value").isin(*junk)
    counted = long.groupBy("column", "value").agg(F.count("*").alias("n")).withColumn("junk", F.coalesce(bad, F.lit(False)))
    good = F.col("value").isNotNull() & ~F.col("junk")
    w = Window.partitionBy("column").orderBy(F.when(good, 0).otherwise(1), F.col("n").desc(), "value")
    counted = counted.withColumns({"rank": F.row_number().over(w), "good": good})
    total = F.sum("n")
    names = F.array_sort(F.collect_list(F.when(F.col("good") & (F.col("rank") <= top), F.struct("rank", F.concat_ws(":", "value", F.col("n").cast("string")).alias("t")))))
    return counted.groupBy("column").agg(
        F.round(100 * F.sum(F.when(F.col("value").isNotNull(), F.col("n")).otherwise(0)) / total, 2).alias("filled_pct"), F.count_if("good").alias("distinct"),
        F.sum(F.when(F.col("junk"), F.col("n")).otherwise(0)).alias("junk"), F.array_join(F.transform(names, lambda x: x["t"]), ", ").alias("top"),
    )


QUANTILES = (0.01, 0.05, 0.5, 0.95, 0.99)


def profile_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    long = long_form(df, columns)
    out = long.groupBy("column").agg(F.round(100 * F.count("value") / F.count("*"), 2).alias("filled_pct"), F.min("value").alias("least"), F.max("value").alias("most"))
    out = with_quantiles(out, long, ["column"], F.col("value"), list(QUANTILES))
    return out.select("column", "filled_pct", "least", *(F.round(F.get("q", F.lit(i)), 6).alias(f"p{int(100 * p):02d}") for i, p in enumerate(QUANTILES)), "most")


def gap_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per column: seconds between values that aren't null, within a vehicle."""
    long = long_form(df, columns, [ID, T, SEQ]).where("value IS NOT NULL")
    w = Window.partitionBy("column", ID).orderBy(T, SEQ)
    long = long.withColumn("gap", (F.col(T) - F.lag(T).over(w)).cast("double")).where("gap IS NOT NULL")
    out = long.groupBy("column").agg(F.count("*").alias("n"), F.round(F.avg("gap"), 4).alias("mean"), F.round(F.stddev_samp("gap"), 4).alias("std"), F.min("gap").alias("least"), F.max("gap").alias("most"))
    out = with_quantiles(out, long, ["column"], F.col("gap"), [0.5, 0.95])
    return out.select("column", "n", "mean", "std", "least", "most", F.round(F.get("q", F.lit(0)), 4).alias("p50"), F.round(F.get("q", F.lit(1)), 4).alias("p95"))


def missing_rates(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, null_pct): one aggregate, then one row for each column."""
    one = df.agg(*(F.avg(F.col(c).isNull().cast("int")).alias(c) for c in columns))
    return long_form(one, columns).select("column", F.round(100 * F.col("value"), 4).alias("null_pct"))


def described(df: DataFrame, by: list[str], value: Column, name: str) -> DataFrame:
    """(by..., <name>_n, _mean, _std, _min, _25, _50, _75, _max) of a value."""
    q = F.percentile(value, [0.25, 0.5, 0.75])
    out = df.groupBy(*by).agg(F.count(value).alias("n"), F.round(F.avg(value.cast("decimal(18,6)")).cast("double"), 4).alias("mean"), F.round(F.stddev_samp(value), 4).alias("std"), F.min(value).alias("min"), q.alias("q"), F.max(value).alias("max"))
    return out.select(*by, *(F.col(c).alias(f"{name}_{c}") for c in ("n", "mean", "std", "min")), *(F.round(F.get("q", F.lit(i)), 4).alias(f"{name}_{p}") for i, p in enumerate((25, 50, 75))), F.col("max").alias(f"{name}_max"))


def gap_diagnosis(df: DataFrame, gaps: DataFrame, nulls: list[str], ids: str, flags: list[str]) -> DataFrame:
    """(id, gap, rows, null_pct, mean_ids, <flag>_mode...): what the rows inside each gap (id, gap, start, end) look like.

    null_pct is over all columns in nulls; the mode of a flag is its commonest value, the smallest of equally common ones.
    """
    rows = rows_in_intervals(df, gaps.select(ID, "gap", "start", "end"))
    missing = sum((F.col(c).isNull().cast("int") for c in nulls[1:]), F.col(nulls[0]).isNull().cast("int"))
    return rows.groupBy(ID, "gap").agg(F.count("*").alias("rows"), F.round(100 * F.avg(missing / len(nulls)), 2).alias("null_pct"), F.round(F.avg(F.col(ids).cast("decimal(18,6)")).cast("double"), 4).alias("mean_ids"), *(F.mode(c, True).alias(f"{c}_mode") for c in flags))


def schema_summary(df: DataFrame) -> DataFrame:
    kinds = dict(df.dtypes)
    one = df.agg(*(F.count(c).alias(c) for c in df.columns))
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("filled"), F.lit(kinds[c]).alias("type")) for c in df.columns)))
    return one.select(each.alias("x")).select("x.*")


def source_spans(sources: dict[str, DataFrame]) -> DataFrame:
    """First and last time and rows of each source."""
    out = None
    for name, df in sources.items():
        one = df.agg(F.lit(name).alias("source"), F.min(T).alias("first"), F.max(T).alias("last"), F.count("*").alias("rows"))
        out = one if out is None else out.unionByName(one)
    return out


def paired(left: DataFrame, right: DataFrame, key: list[str], how: str = "full_outer") -> DataFrame:
    """Both copies by key, columns prefixed l_ and r_, and has_l, has_r."""
    a = left.select(*key, *(F.col(c).alias(f"l_{c}") for c in left.columns if c not in key), F.lit(True).alias("has_l"))
    b = right.select(*key, *(F.col(c).alias(f"r_{c}") for c in right.columns if c not in key), F.lit(True).alias("has_r"))
    return a.join(b, key, how)


def mismatch_counts(pairs: DataFrame, columns: list[str]) -> DataFrame:
    """(column, differing) over matched rows; null equals null."""
    one = pairs.where("has_l AND has_r").agg(*(F.count_if(~F.col(f"l_{c}").eqNullSafe(F.col(f"r_{c}"))).alias(c) for c in columns))
    return long_form(one, columns, kind="long").withColumnRenamed("value", "differing")


def row_differences(pairs: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Rows with a difference, and a map of the columns that differ."""
    entry = lambda c: F.when(~F.col(f"l_{c}").eqNullSafe(F.col(f"r_{c}")), F.concat_ws("|", F.coalesce(F.col(f"l_{c}").cast("string"), F.lit("null")), F.coalesce(F.col(f"r_{c}").cast("string"), F.lit("null"))))
    items = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, columns)), F.array(*map(entry, columns))), lambda _, v: v.isNotNull())
    return pairs.where("has_l AND has_r").select(*key, items.alias("differences")).where(F.size("differences") > 0)


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, r): Pearson over rows where both have a value."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    both = lambda a, b: F.col(a).isNotNull() & F.col(b).isNotNull()
    one = df.agg(*(F.corr(F.when(both(a, b), F.col(a)), F.when(both(a, b), F.col(b))).alias(f"{a}|{b}") for a, b in pairs))
    each = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.round(F.col(f"`{a}|{b}`"), 6).alias("r")) for a, b in pairs)))
    return one.select(each.alias("x")).select("x.*")


def top_values(df: DataFrame, by: list[str], value: Column, k: int) -> DataFrame:
    """The k commonest values of each group; ties go to the smaller value."""
    counted = df.groupBy(*by, value.alias("value")).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*by).orderBy(F.col("n").desc(), "value")
    return counted.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def mean_interval(df: DataFrame, keys: list[str], value: Column, level: float = 0.995) -> DataFrame:
    """(keys, n, mean, half): the mean of a value and half the width of its t interval, for each group and (keys null) for all; half is null for fewer than two values."""
    n = F.count(value)
    half = t_column((1 + level) / 2, n - 1) * F.stddev_samp(value) / F.sqrt(n)
    return df.rollup(*keys).agg(n.alias("n"), F.round(F.avg(value.cast("decimal(18,6)")).cast("double"), 6).alias("mean"), F.round(half, 3).alias("half"))
