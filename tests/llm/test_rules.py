"""The packing rule, suppression of detections, and the order of shards, against plain versions."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetlens.llm import licenses, packing, sharding
from fleetlens.llm.common import LOWER, UPPER


@pytest.mark.parametrize("capacity,sizes", [(10, (1, 9)), (64, (1, 63)), (64, (5, 20)), (100, (40, 60))])
def test_packing_takes_the_level_of_the_least_sum_of_squares(capacity, sizes):
    rng = random.Random(capacity)
    levels, plain = packing.LevelArray(capacity), [0] * (capacity + 1)
    for _ in range(500):
        size = rng.randint(*sizes)

        def squares(h):
            after = list(plain)
            after[h] -= h > 0
            after[h + size] += 1
            return sum(x * x for x in after[1:capacity])

        open_levels = [0, *(h for h in range(1, capacity - size + 1) if plain[h])]
        least = min(map(squares, open_levels))
        want = max(h for h in open_levels if squares(h) == least)
        assert levels.choose(size) == want
        full = levels.place((0, 0, np.zeros(size, "<u4"), size))
        plain[want] -= want > 0
        plain[want + size] += 1
        assert (full is not None) == (want + size == capacity)
        plain[capacity] = 0
        assert levels.count[1:capacity].tolist() == plain[1:capacity]


PHRASES = [
    "GNU General Public License version 2 or later", "GPL", "gpl v3", "gplv2 or later", "GNU Lesser General Public License version 2.1", "lgpl 3.0 only", "MIT License", "the MIT license", "Apache License, Version 2.0",
    "licensed under the apache license version 2 0", "CC BY", "cc-by-sa 4.0", "All rights reserved.", "General Public License", "BSD 3-Clause", "Mozilla Public License 2.0", "released under the terms of the GNU GPL", "public domain",
    "permission is hereby granted free of charge to any person obtaining a copy", "Creative Commons Attribution 4.0", "ISC license", "Eclipse Public License", "cc by cc by", "unlicense", "www.gnu.org/licenses/gpl.html",
]


def plain_detections(text):
    words = re.sub(licenses.NOT_WORD, " ", text.translate(str.maketrans(UPPER, LOWER))).strip(" ")
    spaced = f" {words} "
    found = []
    for i, (label, priority, _, pattern) in enumerate(licenses.rules(licenses.BASE)):
        for m in re.finditer(f"(?<= )(?:{pattern})(?= )", spaced):
            first = spaced[: m.start()].count(" ") - 1
            found.append((first, first + m.group().count(" "), priority, i, label))
    out = []
    for d in found:
        first, last, priority, rule, _ = d
        inside = [o for o in found if o is not d and o[0] <= first and o[1] >= last]
        better = any(o[2] < priority or o[2] == priority and ((o[1] - o[0]) > last - first or (o[1] - o[0]) == last - first and o[3] < rule) for o in inside)
        out.append((*d, priority == 0 or not better))
    return sorted(out)


def test_suppression_by_brute_force(spark):
    rng = random.Random(11)
    texts = [" ".join(rng.choice(PHRASES) if rng.random() < 0.5 else rng.choice(["word", "copyright", "2024", "and", "license", "version 2", "v3", "or later"]) for _ in range(rng.randint(1, 25))) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    several = 0
    for r in licenses.detections(df).collect():
        want = plain_detections(texts[r.doc_id])
        assert sorted((h.first, h.last, h.priority, h.rule, h.label, h.kept) for h in r.hits) == want
        several += len(want) > 3 and not all(h[5] for h in want)
    assert several > 50
    for r in licenses.license_scan(df).collect():
        kept = [h for h in plain_detections(texts[r.doc_id]) if h[5]]
        assert r.labels == ",".join(sorted({h[4] for h in kept})) and r.n_kept == len(kept)


@pytest.fixture(scope="module")
def cells(spark):
    rng = random.Random(5)
    rows = [(i, "x" * rng.choice([10, 200, 3000]), rng.choice("abcdef"), f"s{rng.randrange(12)}") for i in range(1500)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


@pytest.mark.parametrize("law", sharding.LAWS)
def test_shards_follow_the_curve(cells, law):
    rows = sharding.shard_documents(cells, 24, law).orderBy("shard", "slot").collect()
    curve = [r.curve for r in rows]
    assert curve == sorted(curve)
    for s in range(24):
        assert [r.slot for r in rows if r.shard == s] == list(range(sum(r.shard == s for r in rows)))
    sizes = [sum(r.size for r in rows if r.shard == s) for s in range(24)]
    counts = [sum(r.shard == s for r in rows) for s in range(24)]
    if law == "rows":
        assert max(counts) - min(counts) <= 1
    else:
        assert max(sizes) - min(sizes) <= 2 * max(r.size for r in rows)


def test_a_filter_reads_few_shards(cells):
    placed = sharding.shard_documents(cells, 24).select("doc_id", "shard").join(cells, "doc_id")
    both = placed.groupBy("lang", "source").agg(F.count_distinct("shard").alias("n")).agg(F.avg("n")).first()[0]
    one = placed.groupBy("lang").agg(F.count_distinct("shard").alias("n")).agg(F.avg("n")).first()[0]
    # dealt by chance, twenty rows of a pair of values would lie in some fourteen shards
    assert both < 6 and one < 20


def test_words_of_a_phrase_in_another_order_are_no_place_of_it(spark):
    df = spark.createDataFrame([(1, "by cc"), (2, "public general license"), (3, "reserved rights all, all rights"), (4, "by cc by")], "doc_id long, text string")
    got = {r.doc_id: (r.n_base, r.first_word, r.last_word, r.base_labels) for r in licenses.license_scan(df).collect()}
    assert got == {1: (0, None, None, ""), 2: (0, None, None, ""), 3: (0, None, None, ""), 4: (1, 1, 1, "cc-by")}
