"""Ranked search, hard negatives and host quality against plain Python versions."""

import collections
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetlens.llm import hard_negatives, host_quality, lexical_search
from fleetlens.llm.common import UPPER, LOWER

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return [t.translate(str.maketrans(UPPER, LOWER)) for t in TERM.findall(text or "")]


def ranked(docs, queries, k):
    bags = [(i, collections.Counter(terms(t))) for i, t in docs]
    n, total = sum(1 for _, b in bags if b), sum(sum(b.values()) for _, b in bags)
    df = collections.Counter(t for _, b in bags for t in b)
    asked = collections.defaultdict(set)
    for item, text in queries:
        asked[item] |= set(terms(text))
    out = []
    for item, words in asked.items():
        scores = []
        for i, b in bags:
            m = 50 + (50 * sum(b.values()) * n) // total if total else 0
            x = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * b[t]) // (1000 * b[t] + 20 * m)) for t in words if b[t])
            if x > 0:
                scores.append((-x, i is None, i))
        out += [(item, r + 1, i, -x) for r, (x, _, i) in enumerate(sorted(scores, key=lambda s: (s[0], s[1], s[2] or 0))[:k])]
    return sorted(out, key=str)


ODD_DOCS = [
    (1, None), (2, ""), (3, "Alpha beta beta"), (4, "alpha BETA beta"), (4, "alpha BETA beta"), (None, "alpha beta beta"), (5, " \t "), (6, "äÖ 中文 gamma_gamma"), (7, "alpha " * 3000 + "rare"),
    (8, "x" * 20_000), (9, "\x00nul alpha\x85beta"), (-3, "alpha beta beta"), (10, "common " * 5), *((100 + i, "common word " + "filler " * (i % 7) + f"u{i % 11}") for i in range(400)),
]
ODD_ITEMS = [(1, "ALPHA beta, beta"), (2, None), (3, ""), (4, "nowhere"), (5, "äÖ 中文 gamma"), (6, "common word u3 rare filler"), (6, "alpha"), (None, "beta u5"), (7, "common")]


@pytest.mark.parametrize("shard_bytes,block,first", [(16 << 20, 128, 2048), (3000, 4, 16), (9000, 128, 8)])
def test_ranked_search(spark, monkeypatch, tmp_path, shard_bytes, block, first):
    monkeypatch.setattr(lexical_search, "BLOCK", block)
    monkeypatch.setattr(lexical_search, "RANGE", first)
    docs = spark.createDataFrame(ODD_DOCS, "doc_id long, text string").withColumns({"term": F.lit(1), "score": F.lit("x"), "shard": F.lit(None)}).repartition(3)
    queries = spark.createDataFrame(ODD_ITEMS, "item_id long, text string").withColumns({"part": F.lit(1), "weight": F.lit(2)})
    lexical_search.build_index(docs, f"{tmp_path}/index", shard_bytes=shard_bytes)
    for k in (3, 50):
        got = [tuple(r) for r in lexical_search.search(queries, spark, f"{tmp_path}/index", k).collect()]
        # rows of one id and score may change places
        assert sorted(got, key=str) == ranked(ODD_DOCS, ODD_ITEMS, k)


def test_search_rejects_blocks_before_unpacking():
    rng = np.random.default_rng(1)
    scale, n = lexical_search.Scale(4000, 400_000), 4000
    import pyarrow as pa

    texts = ["common " * int(rng.integers(1, 60)) + ("rare " * 9 if i in (3, 5, 9) else "") for i in range(n)]
    batch = lexical_search.shard_lists(0, pa.array(range(n)), pa.array(texts))
    rows = {r["term"]: r for r in batch.to_pylist()}
    norm = scale.norm(np.frombuffer(rows[""]["data"], np.int32))
    lists = [lexical_search.Postings(w, *(rows[t][c] for c in ("blocks", "impacts", "data")), scale, norm) for t, w in (("common", 10), ("rare", 9000))]
    docs, score = lexical_search.best(lists, n, 2)
    assert len(lists[0].last) > 30 and len(lists[0].unpacked) < len(lists[0].last)
    assert set(docs) <= {3, 5, 9} and score[0] >= score[1] > 0


def test_impacts_hold_the_largest_score_of_each_block():
    import pyarrow as pa

    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice(["a", "b", "c"], int(rng.integers(1, 40)))) for _ in range(700)]
    batch = lexical_search.shard_lists(0, pa.array(range(700)), pa.array(texts))
    for scale in (lexical_search.Scale(700, 9000), lexical_search.Scale(5, 1_000_000)):
        for r in batch.to_pylist():
            if r["term"]:
                norm = scale.norm(np.array([len(t.split()) for t in texts]))
                p = lexical_search.Postings(7, r["blocks"], r["impacts"], r["data"], scale, norm)
                for b in range(len(p.last)):
                    docs, scores = p.block(b)
                    assert scores.max() == p.block_most[b]
                    assert [7 * scale.part(np.array([texts[d].split().count(r["term"])]), norm[d])[0] for d in docs] == scores.tolist()


def test_ranked_search_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame(ODD_ITEMS, "item_id long, text string")
    assert lexical_search.ranked_search(none, some).count() == 0
    assert lexical_search.ranked_search(spark.createDataFrame(ODD_DOCS[:5], "doc_id long, text string"), some.limit(0)).count() == 0


def mined(rows, positives=5, negatives=10):
    """rows: (id, label, integers)."""
    out = []
    for a, label, v in rows:
        if a % 100:
            continue
        score = [(-sum(x * y for x, y in zip(v, w)), i, k) for i, k, w in rows if i != a]
        for s, p, _ in sorted(x for x in score if x[2] == label)[:positives]:
            near = sorted(x for x in score if x[2] != label and 30 * -s <= 100 * -x[0] <= 90 * -s)[:negatives]
            out += [(a, p, r + 1, n, -s, -t) for r, (t, n, _) in enumerate(near)]
    return sorted(out)


@pytest.mark.parametrize("tree", [{}, {"leaf_rows": 8, "part_rows": 20, "fan": 3}, {"leaf_rows": 30, "part_rows": 7, "fan": 6, "sample": 60}])
def test_hard_negatives(spark, tree):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 8))
    rows = [(i, int(rng.integers(3)), (centres[i % 6] + rng.normal(size=8) * rng.choice([0.02, 0.4])).tolist()) for i in range(0, 420)]
    rows += [(1000, 1, [0.0] * 8), (1100, 2, rows[7][2]), (1101, 0, rows[7][2]), (1102, 2, rows[7][2]), (1103, 2, rows[7][2]), (1200, 0, [1.0, 2.0]), (1201, 0, [])]
    odd = [(None, 1, [1.0] * 8), (1300, None, [1.0] * 8), (1400, 1, None), (1500, 1, [1.0, None]), (1600, 1, [float("nan")] * 8), (1700, 1, [float("inf")] * 8)]
    df = spark.createDataFrame([(i, k, None if v is None else v) for i, k, v in rows + odd], "vec_id long, label int, embedding array<double>").withColumns({"leaf": F.lit(1), "score": F.lit("x"), "key": F.lit(0)})
    got = hard_negatives.mine(df, F.col("label"), F.col("vec_id") % 100 == 0, **tree).collect()
    want = mined([(i, k, [math.floor(256 * x) for x in [*v, *[0.0] * (8 - len(v))]] if v else [0] * 8) for i, k, v in rows])
    assert sorted((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in got) == want
    assert len(want) > 100


def test_hard_negatives_leave_far_subtrees_out(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(8, 32))
    rows = [(i, int(rng.integers(3)), (centres[i % 8] + rng.normal(size=32) * 0.05).tolist()) for i in range(800)]
    forest = hard_negatives.plant(hard_negatives.usable(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>"), "vec_id", F.col("label"), "embedding"), leaf_rows=50, fan=8)
    x = np.array([[math.floor(256 * c) for c in r[2]] for r in rows], float)
    leaf = hard_negatives.leaves_of(forest.router.tree, x)
    score = x[:40] @ x.T
    least = np.sort(score, 1)[:, -20]
    open_ = forest.router.meets(x[:40], least, np.full(40, hard_negatives.ALWAYS))
    for q in range(40):
        assert open_[q, leaf[score[q] >= least[q]]].all()
    assert open_.mean() < 0.5


def test_hard_negatives_of_large_numbers_and_empty_tables(spark):
    rows = [(0, 1, [1e6, 3.0]), (1, 1, [1e6, 1.0]), (2, 2, [5e5, 7.0]), (3, 2, [8e5, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    got = hard_negatives.mine(df, F.col("label"), F.col("vec_id") % 100 == 0).collect()
    assert sorted(tuple(r) for r in got) == mined([(i, k, [math.floor(256 * x) for x in v]) for i, k, v in rows])
    assert hard_negatives.mine_embeddings(df.limit(0).withColumn("embedding", F.col("embedding").cast("array<float>"))).count() == 0


def counts(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


ODD_TEXTS = [
    (1, None, "a"), (2, "", "a"), (3, " \n\t\n ", None), (4, "one two three four five six seven eight", "a"), (4, "one two three four five six seven eight", "a"), (None, "x y " * 30, None),
    (5, "a b c d e f g h i " * 2, "b"), (6, " ".join(f"w{i % 40}" for i in range(5000)), "b"), (7, "äö\x85中文 #$%\nlast\r\nlast\r\n\nlast", "b"), (8, "\n".join(["same line here"] * 9 + ["other"]), "b"), (9, "w " * 7, "c"), (10, "w " * 9, "c"),
]


def test_quality_counts(spark):
    df = spark.createDataFrame(ODD_TEXTS, "doc_id long, text string, source string").withColumns({"host": F.lit(1), "words": F.lit(2), "kept": F.lit("x"), "salt": F.lit(0), "rejected": F.lit(5)})
    got = host_quality.judge(df).collect()
    key = lambda r: str(r)
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got), key=key) == sorted(((i, *counts(t)) for i, t, _ in ODD_TEXTS), key=key)
    for r in got:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
    assert host_quality.judge(df.limit(0)).count() == 0


def test_host_verdicts(spark):
    good = " ".join(f"word{i}" for i in range(60))
    texts = [("clean", good)] * 80 + [("mostly", good)] * 60 + [("mostly", "too short")] * 40 + [("junk", "too short")] * 90 + [("junk", good)] * 10 + [("tiny", "too short")] + [("tiny", good)] + [(None, good)] * 3
    texts += [(f"h{i}", good) for i in range(40)]
    df = spark.createDataFrame([(i, t, s) for i, (s, t) in enumerate(texts)], "doc_id long, text string, source string")
    by_id = {r.doc_id: r for r in host_quality.judge(df).collect()}
    # shrunk rates by the formulas of the docstring
    n, f = collections.Counter(s for s, _ in texts if s), collections.Counter(s for s, t in texts if s and t != good)
    k, total, failed = len(n), sum(n.values()), sum(f.values())
    mean, inside = failed / total, sum(f[h] * (1 - f[h] / n[h]) for h in n) / (total - k)
    between, size = sum(n[h] * (f[h] / n[h] - mean) ** 2 for h in n) / (k - 1), (total - sum(x * x for x in n.values()) / total) / (k - 1)
    alike = (between - inside) / (between + (size - 1) * inside)
    strength = min(max(1 / alike - 1, 10), 1000) if alike > 0 else 1000
    bad = {h for h in n if (f[h] + mean * strength) / (n[h] + strength) > 0.5}
    assert bad == {"junk"}
    for i, (s, t) in enumerate(texts):
        assert by_id[i].host_rejected == (s in bad)
        assert by_id[i].kept == (t == good and s not in bad)
