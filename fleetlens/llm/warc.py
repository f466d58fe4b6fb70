"""A content-addressed WARC archive.

Writing cuts each page into a WARC record: header lines and a payload. Payload bytes are stored once by SHA-256 in one
table; exact record headers, with their digest, in another. Of records with one payload, that with the smallest id is
the response and the others revisit it; payloads under min_bytes are too small to be worth a reference. Reading
verifies each stored payload against its digest, joins headers to payloads and gives back the records, byte for byte.

Null payloads count as empty. Rows that repeat an id are records of their own, with the record id of their page; those
that repeat the response's id are responses as well. A row without an id gives a record without an id line, which others
don't refer to; it revisits the smallest id, and where no record of its payload has an id, it is a response. An empty
table gives an empty archive. Headers name the page's url; a null url leaves the line out. In a url, characters that end
a line for some reader are percent-encoded. Other columns don't matter, whatever their names.

Digests travel without payloads: a payload is stored once, and verified once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

END = "\r\n"
#: Characters that end a line somewhere, and their percent-encoded UTF-8.
LINE_ENDS = {"\n": "%0A", "\x0b": "%0B", "\x0c": "%0C", "\r": "%0D", "\x85": "%C2%85", "\u2028": "%E2%80%A8", "\u2029": "%E2%80%A9"}


def record_id(page: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), page.cast("string"), F.lit(">"))


def archive(pages: DataFrame, path: str, min_bytes: int = 100, date: str = "2024-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> None:
    """Writes payloads and headers below path."""
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"), F.sha2(payload, 256).alias("digest"), F.octet_length(payload).cast("long").alias("bytes"))
    slim = rows.select("page_id", "url", "digest", "bytes")
    # read back, so that the join may split a digest of many records
    first = slim.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    first.write.parquet(f"{path}/repeated")
    first = pages.sparkSession.read.schema(first.schema).parquet(f"{path}/repeated")
    revisits = (F.col("bytes") >= min_bytes) & F.coalesce(F.col("page_id") != F.col("first_id"), F.lit(True))
    marked = slim.join(first, "digest", "left").withColumn("refers_to", F.when(revisits, F.col("first_id")))
    url = F.col("url")
    for end, code in LINE_ENDS.items():
        url = F.replace(url, F.lit(end), F.lit(code))
    line = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit(END))).otherwise("")
    kind = F.when(F.col("refers_to").isNull(), "response").otherwise("revisit")
    header = F.concat(
        F.lit(f"WARC/1.1{END}"),
        line("WARC-Type", kind),
        line("WARC-Record-ID", record_id(F.col("page_id"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", url),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        line("WARC-Refers-To", record_id(F.col("refers_to"))),
        line("WARC-Profile", F.when(F.col("refers_to").isNotNull(), "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        line("Content-Length", F.when(F.col("refers_to").isNull(), F.col("bytes")).otherwise(0).cast("string")),
        F.lit(END),
    )
    marked.select("page_id", "digest", header.cast("binary").alias("header")).write.parquet(f"{path}/headers")
    # copies collapse in each task before bytes move
    rows.groupBy("digest", "payload").agg(F.lit(1).alias("one")).select("digest", "payload").write.parquet(f"{path}/payloads")


def payload_store(spark: SparkSession, path: str) -> DataFrame:
    """(digest, payload), each verified: another digest, or two payloads under one, is an error."""
    stored = spark.read.parquet(f"{path}/payloads")
    real = F.sha2("payload", 256)
    return stored.select("payload", F.when(real == F.col("digest"), real).otherwise(F.raise_error(F.concat(F.lit("payload doesn't match its digest "), F.col("digest")))).alias("digest"))


def reconstruct(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, digest, header, payload, record): the payload is whole for revisits too; record holds what the WARC file would."""
    out = spark.read.parquet(f"{path}/headers").join(payload_store(spark, path), "digest")
    own = F.contains(F.col("header").cast("string"), F.lit(f"WARC-Type: response{END}"))
    record = F.concat(F.col("header"), F.when(own, F.col("payload")).otherwise(F.lit(b"")), F.lit((END * 2).encode()))
    return out.select("page_id", "digest", "header", "payload", record.alias("record"))


def field(header: Column, name: str) -> Column:
    """A header field of a record, null where it has none."""
    lines = F.split(F.substring_index(header.cast("string"), END * 2, 1), END)
    found = F.get(F.filter(lines, lambda x: F.startswith(x, F.lit(f"{name}: "))), F.lit(0))
    return F.substring(found, len(name) + 3, 2**31 - 1)


def records(spark: SparkSession, path: str) -> DataFrame:
    """What the archive says, read from its records: (page_id, payload_bytes, payload_digest, record_type, refers_to)."""
    held = payload_store(spark, path).select("digest", F.octet_length("payload").cast("long").alias("payload_bytes"))
    r = spark.read.parquet(f"{path}/headers").join(held, "digest")
    header = F.col("header")
    page = F.regexp_extract(field(header, "WARC-Record-ID"), "^<urn:page:(-?[0-9]+)>$", 1)
    refers = F.regexp_extract(field(header, "WARC-Refers-To"), "^<urn:page:(-?[0-9]+)>$", 1)
    return r.select(
        page.try_cast("long").alias("page_id"),
        "payload_bytes",
        F.col("digest").alias("payload_digest"),
        field(header, "WARC-Type").alias("record_type"),
        refers.try_cast("long").alias("refers_to"),
    )
