"""Quality rules and host verdicts. DataFrame functions only.

Each document is judged by rules on its own text. Failures are counted by host (the source of a document) and rule; a
host's rate is shrunk towards what hosts have in common, by a beta prior fitted to the rates of all hosts (by their
moments), so that a host with few documents is judged by the others as well. A host one of whose shrunk rates is above
the limit is rejected, and the verdict is joined back to its documents.

Words are runs of characters other than blank, tab, line ends, vertical tab and form feed. Windows of words are compared
by 64-bit codes first, and those of equal codes by their words. Everything about a text happens within its row, in time
that grows with its length (n log n where windows repeat), so very long texts need no special case.

A null text has no words, fails the rule on length and counts for its host like any other. Documents without a source have
no host: nothing is counted and their own rules decide. Rows that repeat an id, and rows without one, are judged one by one.
An empty table gives no rows. Other columns don't matter, whatever their names. Hosts of equal rates get equal verdicts.

Counts by host combine before the shuffle; only rejected hosts are joined back, each `SALTS` times, to documents dealt by
source and a salt, so that a host with a third of all rows is many tasks' work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import written

#: Characters between words.
BLANK = r"[\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
#: Words of a window that may stand once in a text.
WINDOW = 8
#: Shares of documents: a host with a larger one is rejected.
LIMIT = 0.5
#: Documents that the prior counts for, at least and at most.
STRENGTH = 10.0, 1000.0
SALTS = 16

#: name: what fails. Over the columns of `counted`.
RULES: dict[str, str] = {
    "short": "n_words < 20",
    "repeats": "100 * n_repeat_words > 30 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "lines": "10 * n_dup_lines > 3 * n_lines",
}
#: Rules that decide alone.
BASE = ("short", "repeats")


def _paired(x: Column, step: int) -> Column:
    """A code for each two codes that stand `step` apart."""
    n = F.size(x) - step
    return F.zip_with(F.slice(x, F.lit(1), n), F.slice(x, F.lit(step + 1), n), lambda a, b: F.xxhash64(a, b))


def counted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", window: int = WINDOW) -> DataFrame:
    """(doc_id, host, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words) of each text; window is a power of two."""
    if window < 2 or window & (window - 1):
        raise ValueError("a window has 2, 4, 8 ... words")
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).cast("string").alias("host"), text.alias("text"))
    # empty pieces stand at the edges of a text alone
    words = F.array_remove(F.split("text", BLANK + "+"), "")
    lines = F.filter(F.split("text", "\n"), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]")))
    df = df.select("doc_id", "host", words.alias("words"), lines.alias("lines"), F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"))
    df = df.select(
        "doc_id",
        "host",
        "words",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
    )
    counts = ["doc_id", "host", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines"]
    codes, step = F.transform("words", lambda w: F.xxhash64(w)), 1
    df = df.select(*counts, "words", F.when(F.col("n_words") > window, codes).alias("codes"))
    while step < window:
        df = df.select(*counts, "words", _paired(F.col("codes"), step).alias("codes"))
        step *= 2
    # texts without equal codes, most of all, end here
    df = df.select(*counts, "words", F.when(F.size(F.array_distinct("codes")) < F.size("codes"), F.col("codes")).alias("codes"))
    df = df.select(*counts, "words", F.sort_array(F.transform("codes", lambda c, i: F.struct(c.alias("code"), (i + 1).alias("at")))).alias("order"))
    same = lambda a, b: F.when(a["code"] == b["code"], F.slice("words", a["at"], F.lit(window)) == F.slice("words", b["at"], F.lit(window))).otherwise(False)
    n = F.size("order") - 1
    meets = F.zip_with(F.slice("order", F.lit(1), n), F.slice("order", F.lit(2), n), lambda a, b: F.when(same(a, b), F.array(a["at"], b["at"])).otherwise(F.array().cast("array<int>")))
    df = df.select(*counts, F.sort_array(F.array_distinct(F.flatten(meets))).alias("starts"))
    # a start covers its window, or what lies before the next start
    upto = F.concat(F.slice("starts", F.lit(2), F.size("starts")), F.array(F.array_max("starts") + window))
    covered = F.aggregate(F.zip_with("starts", upto, lambda a, b: F.least(b - a, F.lit(window))), F.lit(0), lambda s, x: s + x)
    return df.select(*counts, F.when(F.size("starts") > 0, covered).otherwise(0).cast("long").alias("n_repeat_words"))


def host_rates(judged: DataFrame, rules: list[str], strength: tuple[float, float] = STRENGTH) -> DataFrame:
    """(host, rule, n, failed, rate): the share of a host's documents that fail a rule, shrunk by the prior of all hosts.

    judged has a boolean column failed_<rule> for each rule. The prior of a rule has the rate of all documents as its mean and
    counts for 1 / r - 1 documents, r being the correlation of two documents of a host (from the variance between hosts
    and inside them): the more hosts differ, the less it counts. Where nothing can be told, it counts for the most.
    """
    by_host = judged.where("host IS NOT NULL").groupBy("host").agg(F.count("*").alias("n"), *(F.count_if(f"failed_{r}").alias(f"f_{r}") for r in rules))
    each = by_host.select("host", "n", F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.col(f"f_{r}").alias("failed")) for r in rules))).alias("x")).select("host", "n", "x.rule", "x.failed")
    n, failed = F.sum("n").cast("double"), F.sum("failed").cast("double")
    sums = each.groupBy("rule").agg(F.count("*").cast("double").alias("k"), n.alias("n"), failed.alias("f"), F.sum(F.col("n").cast("double") * F.col("n")).alias("n2"), F.sum(F.col("failed") * F.col("failed") / F.col("n")).alias("f2"))
    between = F.expr("(f2 - f * f / n) / nullif(k - 1, 0)")
    inside = F.expr("(f - f2) / nullif(n - k, 0)")
    size = F.expr("(n - n2 / n) / nullif(k - 1, 0)")
    # alike: how much two documents of a host have in common, by the analysis of variance
    alike = (between - inside) / F.nullif(between + (size - 1) * inside, F.lit(0.0))
    counts_for = F.when(alike > 0, F.least(F.greatest(1 / F.when(alike > 0, alike) - 1, F.lit(strength[0])), F.lit(strength[1]))).otherwise(strength[1])
    prior = sums.select("rule", F.expr("f / n").alias("mean"), counts_for.alias("strength"))
    shrunk = (F.col("failed") + F.col("mean") * F.col("strength")) / (F.col("n") + F.col("strength"))
    # a prior is one row for each rule
    return each.join(F.broadcast(prior), "rule").select("host", "rule", "n", "failed", shrunk.alias("rate"))


def judge(docs: DataFrame, rules: dict[str, str] | None = None, base: tuple[str, ...] = BASE, limit: float = LIMIT, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The counts of every document, base_failed, host_rejected and kept."""
    rules = RULES if rules is None else rules
    judged = counted(docs, id_col, text_col, host_col).withColumns({f"failed_{r}": F.expr(sql) for r, sql in rules.items()})
    # texts are read once; what is left of them are numbers
    judged = written(judged.withColumn("salt", F.pmod(F.xxhash64("doc_id", "n_words", "word_chars"), F.lit(SALTS)).cast("int")), "judged")
    bad = host_rates(judged, list(rules)).where(F.col("rate") > limit).select("host").distinct()
    bad = bad.select("host", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), F.lit(True).alias("rejected"))
    out = judged.join(bad, ["host", "salt"], "left").withColumn("host_rejected", F.coalesce("rejected", F.lit(False)))
    failed = F.lit(False)
    for r in base:
        failed = failed | F.col(f"failed_{r}")
    out = out.withColumn("base_failed", failed)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "host_rejected", (~F.col("base_failed") & ~F.col("host_rejected")).alias("kept"))
