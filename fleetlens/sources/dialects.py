"""Text tables whose files differ in delimiter, quotes and header.

A dialect is told from the first `HEAD` bytes of a file: each pair of delimiter and quote is scored by how many of the
sample's lines have the commonest number of fields, and how many fields that is. Files of one dialect and one header are
read together by Spark's reader; there are as many readers as different dialects, not as files.
"""

from __future__ import annotations

import csv
import re
from collections import Counter
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.sources.telemetry import conform

DELIMITERS = ("|", ",", ";", "\t")
QUOTES = ('"', "'")
#: Bytes of a file that its dialect is told from.
HEAD = 1 << 16


class Dialect(NamedTuple):
    delimiter: str
    quote: str
    header: tuple[str, ...] | None


def _is_number(x: str) -> bool:
    try:
        float(x)
    except ValueError:
        return False
    return True


def _rows(lines: list[str], delimiter: str, quote: str) -> list[list[str]]:
    return [row for row in csv.reader(lines, delimiter=delimiter, quotechar=quote, escapechar="\\", skipinitialspace=True) if row]


def _score(rows: list[list[str]], quote: str) -> float:
    """Share of rows with the commonest number of fields, less what a single field or stray quotes take away."""
    if not rows:
        return 0.0
    fields, times = Counter(map(len, rows)).most_common(1)[0]
    stray = sum(x[:1] in QUOTES and x[:1] == x[-1:] and len(x) > 1 for r in rows for x in r) / max(1, sum(map(len, rows)))
    return times / len(rows) * (1 - 1 / fields) * (1 - stray)


def tell_dialect(text: str, whole: bool = True) -> Dialect:
    """The dialect of a file that begins with text; whole: nothing follows, so that the last line counts as well."""
    lines = text.splitlines()
    lines = [x for x in (lines if whole or len(lines) < 2 else lines[:-1]) if x.strip()]
    scored = []
    for i, d in enumerate(DELIMITERS):
        for j, q in enumerate(QUOTES):
            try:
                scored.append((_score(_rows(lines, d, q), q), -j, -i, d, q))
            except csv.Error:
                continue
    _, _, _, delimiter, quote = max(scored, default=(0, 0, 0, ",", '"'))
    rows = _rows(lines, delimiter, quote)
    first, rest = [x.strip() for x in rows[0]] if rows else [], rows[1:]
    # names are no numbers and stand once; where no column below has numbers, they must look like names as well
    named = bool(first) and all(x and not _is_number(x) for x in first) and len(set(x.lower() for x in first)) == len(first)
    typed = any(_is_number(r[i]) for r in rest for i in range(min(len(r), len(first))))
    header = named and (typed or all(re.fullmatch(r"[^\W\d][\w .%()/-]*", x) for x in first))
    return Dialect(delimiter, quote, tuple(x.lower() for x in first) if header else None)


def files_by_dialect(spark: SparkSession, path: str) -> dict[Dialect, list[str]]:
    """The files below path (names that begin with _ or . aside); the driver reads the head of each, and keeps its dialect alone."""
    jvm = spark._jvm
    top = jvm.org.apache.hadoop.fs.Path(path)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    found: dict[Dialect, list[str]] = {}
    files = fs.listFiles(top, True)
    while files.hasNext():
        status = files.next()
        place = status.getPath()
        if place.getName()[:1] in "_." or not status.getLen():
            continue
        stream = fs.open(place)
        try:
            head = bytes(stream.readNBytes(HEAD))
        finally:
            stream.close()
        found.setdefault(tell_dialect(head.decode("utf-8", "replace"), status.getLen() <= HEAD), []).append(place.toString())
    return found


def scan_csv_conform(spark: SparkSession, path: str, schema: T.StructType, ts_col: str = "ts") -> DataFrame:
    """The schema's columns of all files below path: names are stripped and lower-cased, rows with a bad timestamp are dropped.

    Files without a header have the schema's columns in its order. Columns that a file lacks are null, others are left out.
    """
    out = None
    for dialect, files in sorted(files_by_dialect(spark, path).items(), key=str):
        names = list(dialect.header) if dialect.header else [f.name for f in schema]
        text = T.StructType([T.StructField(n, T.StringType()) for n in names])
        df = spark.read.csv(files, schema=text, sep=dialect.delimiter, quote=dialect.quote, header=dialect.header is not None, enforceSchema=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
        if ts_col in names:
            df = df.withColumn(ts_col, F.try_to_timestamp(F.col(ts_col)))
        df = conform(df, schema).where(F.col(ts_col).isNotNull())
        out = df if out is None else out.unionByName(df)
    return out if out is not None else spark.createDataFrame([], schema)
