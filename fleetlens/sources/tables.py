"""Database dumps as tables; copies of tables with new types or in another schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What a header consists of: names (in double quotes, or without blanks and punctuation) and the bracket before the columns.
HEADER_PARTS = r'"(?:[^"]|"")*"|[(]|[^\s,().";]+'


def copy_header(line: Column) -> Column:
    """(table, names) of a line `COPY schema.table (name, ...) FROM stdin;`, null for other lines. The schema may lack, names may be quoted."""
    parts = F.regexp_extract_all(line, F.lit(HEADER_PARTS), F.lit(0))
    bracket = F.array_position(parts, "(").cast("int")
    end = F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), F.lit(2))
    plain = lambda name: F.when(F.startswith(name, F.lit('"')), F.replace(F.substring(name, F.lit(2), F.length(name) - 2), F.lit('""'), F.lit('"'))).otherwise(name)
    names = F.transform(F.slice(parts, bracket + 1, F.greatest(F.size(parts) - 2 - bracket, F.lit(0))), plain)
    header = F.struct(plain(F.get(parts, bracket - 2)).alias("table"), names.alias("names"))
    return F.when(F.startswith(line, F.lit("COPY ")) & (bracket > 2) & (F.array_join(end, " ") == "FROM stdin"), header)


def scan_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, n, value): the lines of text files. n ascends within a split (block) of a file, blocks within the file."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"), "value")


def scan_dump_tables(lines: DataFrame, skip: tuple[str, ...] = ()) -> DataFrame:
    """(file, block, n, table, names, values): the rows between `COPY ... FROM stdin;` and `\\.` in a dump; \\N is null.

    Each block is read by itself; only its last marker goes on to the next one, so a large file is no single task. Tables
    in `skip` (personal data) are left out. Values stay text; `dump_table` types them.
    """
    value = F.col("value")
    # a header, or the end of a table, which has no name
    end = F.struct(F.lit("").alias("table"), F.array().cast("array<string>").alias("names"))
    mark = F.coalesce(copy_header(value), F.when(F.trim(value) == "\\.", end))
    marked = lines.withColumn("mark", mark)
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = marked.groupBy("file", "block").agg(F.max_by("mark", F.when(F.col("mark").isNotNull(), F.col("n"))).alias("last"))
    blocks = blocks.select("file", "block", F.last("last", True).over(before).alias("carried"))
    so_far = Window.partitionBy("file", "block").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    header = F.coalesce(F.last("mark", True).over(so_far), "carried")
    rows = marked.join(blocks, ["file", "block"]).withColumn("header", header).where("mark IS NULL AND header.table <> ''")
    values = F.transform(F.split(value, "\t", -1), lambda v: F.when(v != "\\N", v))
    out = rows.select("file", "block", "n", "header.table", "header.names", values.alias("values"))
    return out.where(~F.col("table").isin(*skip)) if skip else out


def dump_table(rows: DataFrame, table: str, types: dict[str, str]) -> DataFrame:
    """One table of a dump with typed columns; what is missing or doesn't fit is null."""
    at = lambda c: F.get("values", (F.array_position("names", c) - 1).cast("int"))
    return rows.where(F.col("table") == table).select(*(at(c).try_cast(t).alias(c) for c, t in types.items()))


def retype(df: DataFrame, types: dict[str, str] | None = None, dates: dict[str, str] | None = None) -> DataFrame:
    """All columns in their order: some cast, text dates parsed by a pattern; what doesn't fit is null."""
    types, dates = types or {}, dates or {}

    def one(c: str) -> Column:
        if c in dates:
            return F.try_to_timestamp(F.col(c), F.lit(dates[c])).cast("date").alias(c)
        return F.col(c).try_cast(types[c]).alias(c) if c in types else F.col(c)

    return df.select(*(one(c) for c in df.columns))


def sink_retype(df: DataFrame, table: str, types: dict[str, str] | None = None, dates: dict[str, str] | None = None) -> None:
    """A new table with the retyped rows; fails where it exists."""
    retype(df, types, dates).write.saveAsTable(table)


def sink_ctas_replicate(spark: SparkSession, tables: list[str], source: str, target: str) -> DataFrame:
    """(table, source_rows, target_rows): copies the tables that the target schema lacks, then counts both sides of each."""
    for t in tables:
        spark.table(f"{source}.{t}").write.mode("ignore").saveAsTable(f"{target}.{t}")
    counts = None
    for t in tables:
        for side, schema in (("source", source), ("target", target)):
            one = spark.table(f"{schema}.{t}").agg(F.count("*").alias("rows")).select(F.lit(t).alias("table"), F.lit(side).alias("side"), "rows")
            counts = one if counts is None else counts.unionByName(one)
    if counts is None:
        return spark.createDataFrame([], "table string, source_rows long, target_rows long")
    rows = lambda side: F.max(F.when(F.col("side") == side, F.col("rows"))).alias(f"{side}_rows")
    return counts.groupBy("table").agg(rows("source"), rows("target"))


def drop_tables(spark: SparkSession, tables: list[str], schema: str) -> None:
    """Drops exactly the tables named."""
    for t in tables:
        spark.sql(f"DROP TABLE IF EXISTS {schema}.{t}")
