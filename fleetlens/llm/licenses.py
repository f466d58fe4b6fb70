"""License scans: ordered signature rules behind a keyword prefilter. DataFrame functions only.

A text is cut into lower-cased words once. A rule has sets of keywords, one of which every text holds that it matches;
rules that have a set whose words all stand in the text are tried, each a hand-written regular expression over the words
with one blank between them; what they match is an interval of words. A detection is dropped
if its interval lies inside one of better priority, or of the same priority and longer (of equal ones the earlier rule
stays). Base phrases have a priority of their own that nothing beats, so their places are all kept. Everything happens
within a row: no shuffle, and memory grows with one text.

Null and empty texts have no words, no detections and a score of 0. Rows are kept as they come, repeated ones and those
without an id too; an empty table gives no rows; other columns don't matter, whatever their names. Time grows with the
length of a text and its number of detections. The places of one rule don't overlap: the leftmost is taken, and the search goes on behind it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import lower_ascii
from fleetlens.llm.license_rules import CONFIDENCE, parsed

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Outputs gathered at once.
BLOCK = 128
#: Phrases that are detected wherever they stand, and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


def rules(base: dict[str, str]) -> list[tuple[str, int, list[list[str]], str]]:
    return [(label, 0, [phrase.split()], phrase) for phrase, label in base.items()] + parsed()


def _rule_table(base: dict[str, str]) -> tuple[Column, Column]:
    """(all rules as an array, every keyword)."""
    every = rules(base)
    table = F.array(
        *(
            F.struct(F.lit(i).alias("rule"), F.lit(label).alias("label"), F.lit(priority).alias("priority"), F.array(*(F.array(*map(F.lit, dict.fromkeys(g))) for g in gates)).alias("gates"), F.lit(f"(?<= )(?:{pattern})(?= )").alias("pattern"))
            for i, (label, priority, gates, pattern) in enumerate(every)
        )
    )
    return table, F.array(*map(F.lit, sorted({k for _, _, gates, _ in every for g in gates for k in g})))


def _blanks(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value made once however often use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(items: Column, start: Column, step: Callable[[Column, Column], tuple[Column, Column]], kind: str) -> Column:
    """The outputs (of type kind) of step, which takes a state and an item and gives the next state and an output.

    Outputs are gathered block by block: appending to an array copies it, so one array for all would take time that
    grows with the square of their number.
    """
    none = F.array().cast(f"array<{kind}>")

    def one(acc: Column, item: Column) -> Column:
        state, out = step(acc["state"], item)
        return F.struct(state.alias("state"), F.concat(acc["out"], F.array(out)).alias("out"))

    def block(held: Column, acc: Column, i: Column) -> Column:
        inner = F.aggregate(F.slice(held, i * BLOCK + 1, F.lit(BLOCK)), F.struct(acc["state"].alias("state"), none.alias("out")), one)
        return bound(inner, lambda x: F.struct(x["state"].alias("state"), F.concat(acc["out"], F.array(x["out"])).alias("out")))

    def whole(held: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(held) - 1) / BLOCK).cast("int"))
        begin = F.struct(start.alias("state"), F.array().cast(f"array<array<{kind}>>").alias("out"))
        return F.when(F.size(held) > 0, F.aggregate(numbers, begin, lambda acc, i: block(held, acc, i), lambda acc: F.flatten(acc["out"]))).otherwise(none)

    return bound(items, whole)


def _places(text: Column, rule: Column) -> Column:
    """Word intervals that a rule matches. text has a blank on either side of each word."""
    found, between = F.regexp_extract_all(text, rule["pattern"], F.lit(0)), F.split(text, rule["pattern"], -1)
    pieces = F.zip_with(F.slice(between, F.lit(1), F.size(found)), found, lambda b, m: F.struct(_blanks(b).alias("before"), _blanks(m).alias("inside")))

    def step(blanks: Column, piece: Column) -> tuple[Column, Column]:
        first = blanks + piece["before"] - 1
        hit = F.struct(first.alias("first"), (first + piece["inside"]).alias("last"), rule["priority"].alias("priority"), rule["rule"].alias("rule"), rule["label"].alias("label"))
        return blanks + piece["before"] + piece["inside"], hit

    return running(pieces, F.lit(0), step, "struct<first:int,last:int,priority:int,rule:int,label:string>")


def detections(docs: DataFrame, base: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, hits) for every row; hits: array of (first, last, priority, rule, label, kept), in order of place."""
    base = BASE if base is None else base
    table, keywords = _rule_table(base)
    words = F.regexp_replace(lower_ascii(F.col(text_col)), NOT_WORD, " ")
    df = docs.select(F.col(id_col).alias("doc_id"), F.trim(words).alias("words"))
    df = df.withColumn("list", F.when(F.col("words") == "", F.array().cast("array<string>")).otherwise(F.split("words", " ")))
    df = df.select("doc_id", "words", F.size("list").cast("long").alias("n_words"), F.array_intersect("list", keywords).alias("seen"))
    spaced = F.concat(F.lit(" "), F.col("words"), F.lit(" "))
    tried = F.filter(table, lambda r: F.exists(r["gates"], lambda g: F.size(F.array_except(g, F.col("seen"))) == 0))
    df = df.select("doc_id", "n_words", "words", F.when(F.size("seen") > 0, tried).alias("tried"))
    hits = F.flatten(F.transform("tried", lambda r: _places(spaced, r)))
    df = df.select("doc_id", "n_words", F.when(F.size("tried") > 0, hits).alias("raw"))
    # containing intervals come first in this order
    ordered = F.sort_array(F.transform("raw", lambda h: F.struct(h["first"].alias("first"), (-h["last"]).alias("end"), h["priority"].alias("priority"), h["rule"].alias("rule"), h["label"].alias("label"))))
    df = df.select("doc_id", "n_words", ordered.alias("ordered"))
    levels = max(CONFIDENCE) + 1

    def step(reach: Column, h: Column) -> tuple[Column, Column]:
        """reach: how far detections of each priority have come."""
        last = -h["end"]
        kept = (h["priority"] == 0) | (F.array_max(F.slice(reach, 1, h["priority"] + 1)) < last)
        hit = F.struct(h["first"].alias("first"), last.alias("last"), h["priority"].alias("priority"), h["rule"].alias("rule"), h["label"].alias("label"), kept.alias("kept"))
        return F.transform(reach, lambda x, i: F.when((i == h["priority"]) & (x < last), last).otherwise(x)), hit

    resolved = running(F.col("ordered"), F.array(*[F.lit(-1)] * levels), step, "struct<first:int,last:int,priority:int,rule:int,label:string,kept:boolean>")
    return df.select("doc_id", "n_words", F.coalesce(resolved, F.array().cast("array<struct<first:int,last:int,priority:int,rule:int,label:string,kept:boolean>>")).alias("hits"))


def summary(found: DataFrame) -> DataFrame:
    """One row for each text: counts and places of base phrases, labels and the surest detection's confidence."""
    base = F.filter("hits", lambda h: h["priority"] == 0)
    kept = F.filter("hits", lambda h: h["kept"])
    names = lambda hits: F.array_join(F.array_sort(F.array_distinct(F.transform(hits, lambda h: h["label"]))), ",")
    sure = F.array_max(F.transform(kept, lambda h: F.get(F.array(*[F.lit(CONFIDENCE[p]) for p in sorted(CONFIDENCE)]), h["priority"])))
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda h: h["first"])).cast("long").alias("first_word"),
        F.array_max(F.transform(base, lambda h: h["first"])).cast("long").alias("last_word"),
        names(base).alias("base_labels"),
        names(kept).alias("labels"),
        F.coalesce(sure, F.lit(0.0)).alias("score"),
        F.size(kept).cast("long").alias("n_kept"),
    )


def license_scan(docs: DataFrame, base: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return summary(detections(docs, base, id_col, text_col))
