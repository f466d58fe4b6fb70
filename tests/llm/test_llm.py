"""Text operators against brute force, on small fixtures and the smallest tables."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fleetlens.llm import bpe, exact_dedup, fingerprints, licenses, ngram_join, packing, sharding, substring_dedup, toxicity, warc, wordcodes
from fleetlens.llm.queries import ORACLES, QUERIES, byte_bpe

ODD = [
    (1, None), (2, ""), (3, "a"), (4, "a"), (5, " \t\n "), (6, "one two three four five"), (7, "x" * 5000), (8, "äö 中文 \U0001f600 <|endoftext|> tail"),
    (9, " ".join(f"w{i % 37}" for i in range(400))), (10, " ".join(f"w{i % 37}" for i in range(400))), (11, "\x00nul and\x85odd blanks\x1c here"), (12, "CC BY 4.0, cc-by. All Rights Reserved!"),
    (12, "CC BY 4.0, cc-by. All Rights Reserved!"), (13, "don't we'll 12345  67   \n\n end "),
]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ODD, "doc_id long, text string")
    return df.withColumns({"words": F.lit(1), "hits": F.lit("x"), "kept": F.lit(True), "bucket": F.lit(2.0)})


@pytest.fixture(scope="module")
def docs(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.collect()}


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(byte_bpe())


def test_bpe_equals_the_library(odd, docs, texts, reference):
    for df, want in ((odd, {k: v or "" for k, v in ODD}), (docs, texts)):
        for r in bpe.round_trip(df, byte_bpe()).collect():
            ids = reference.encode(want[r.doc_id], add_special_tokens=False).ids
            assert r.n_tokens == len(ids)
            assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
            assert r.decoded_sha256 == hashlib.sha256(reference.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_decodes_what_it_encodes(odd):
    back = {r.doc_id: r.text for r in bpe.decode(bpe.encode(odd, byte_bpe()), byte_bpe()).collect()}
    assert back == {k: v or "" for k, v in ODD}


def test_bpe_cuts_every_character_as_the_library(spark, reference):
    marks = [chr(c) for c in range(0x3100) if not 0xD800 <= c < 0xE000]
    text = " ".join(f"a{c}1{c}{c}-{c}" for c in marks)
    (r,) = bpe.encode(spark.createDataFrame([(1, text)], "doc_id long, text string"), byte_bpe()).collect()
    assert r.ids == reference.encode(text, add_special_tokens=False).ids


def test_packing_covers_each_token_once(odd, docs, texts, reference):
    for df, want in ((odd.where("doc_id <> 12"), {k: v or "" for k, v in ODD}), (docs, texts)):
        pieces = packing.pack(df, byte_bpe()).collect()
        by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
        for p in pieces:
            by_doc[p.doc_id].append(p)
            by_seq[p.sequence_id].append(p)
        for doc, parts in by_doc.items():
            ids = np.array([*reference.encode(want[doc], add_special_tokens=False).ids, 0], "<u4")
            at = 0
            for p in sorted(parts, key=lambda p: p.start):
                assert p.start == at and p.doc_tokens == len(ids)
                assert p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
                at += p.length
            assert at == len(ids)
        for parts in by_seq.values():
            at = 0
            for p in sorted(parts, key=lambda p: p.offset):
                assert p.offset == at
                at += p.length
            assert at <= 1024
        padding = 1 - sum(p.length for p in pieces) / 1024 / len(by_seq)
        assert df is odd or padding < 0.05 or len(by_seq) < 30


def test_sum_of_squares_choice():
    levels = packing.LevelArray(10)
    for size in (6, 6, 6, 3):
        levels.place((0, 0, np.zeros(size, "<u4"), size))
    # three windows at 6: moving one to 9 makes 4 + 1, a new one at 3 makes 9 + 1
    assert levels.count[6] == 2 and levels.count[9] == 1


def brute_join(rows, k, percent):
    sets, sizes = {}, []
    for i, t in rows:
        w = (t or "").encode().lower().split()
        s = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
        sizes.append((i, len(s)))
        sets.setdefault(i, []).append(s)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    flat = [(i, s) for i, ss in sets.items() for s in ss if s]
    for i, a in flat:
        for j, b in flat:
            if j < i and min(len(a), len(b)) * 100 >= percent * max(len(a), len(b)) and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return sorted((i, n, find(i)) for i, n in sizes)


@pytest.mark.parametrize("k,percent", [(3, 90), (5, 80)])
def test_ngram_join(spark, odd, docs, k, percent):
    rng = np.random.default_rng(3)
    base = [f"t{rng.integers(500)}" for _ in range(120)]
    near = []
    for i in range(60):
        w = list(base)
        for _ in range(int(rng.integers(0, 5))):
            w[rng.integers(len(w))] = f"n{rng.integers(10_000)}"
        near.append((1000 + i, " ".join(w)))
    for df in (odd.select("doc_id", "text"), docs.select("doc_id", "text"), spark.createDataFrame(near * 2, "doc_id long, text string")):
        rows = [(r.doc_id, r.text) for r in df.collect()]
        got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.ngram_join(df, k, percent).collect())
        assert got == brute_join(rows, k, percent)


def test_ngram_join_in_parts(spark, docs, monkeypatch):
    monkeypatch.setattr(ngram_join, "CHUNK_BYTES", 18_000)
    monkeypatch.setattr(ngram_join, "PART_GRAMS", 300)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.ngram_join(docs, 3, 90).collect())
    assert got == brute_join(rows, 3, 90)


def brute_passages(rows, k):
    first, out = {}, {}
    for i, t in sorted(rows):
        w = (t or "").encode().split()
        keep = [True] * len(w)
        for j in range(len(w) - k + 1):
            if first.setdefault(tuple(w[j : j + k]), (i, j)) != (i, j):
                keep[j : j + k] = [False] * k
        out[i] = (len(w), keep.count(False), b" ".join(x for x, y in zip(w, keep) if y).decode())
    return out


@pytest.mark.parametrize("k", [2, 20, 50])
def test_substring_dedup(odd, docs, k, monkeypatch):
    monkeypatch.setattr(substring_dedup, "CHUNK_BYTES", 24_000)
    for df in (odd, docs):
        rows = [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]
        want = brute_passages(set(rows), k)
        for r in substring_dedup.substring_dedup(df, k).collect():
            assert (r.n_words, r.n_removed, r.kept_text) == want[r.doc_id]


#: Rows without an id, and rows of one id with different texts: passages of 60 words, near copies, exact copies, texts of their own.
def words_of(name, n):
    return " ".join(f"{name}{i}" for i in range(n))


UNNAMED = [
    (None, words_of("alone", 80)), (None, words_of("other", 80)), (None, words_of("twice", 80)), (None, words_of("twice", 80)), (20, words_of("named", 80)), (None, words_of("named", 80)),
    (21, words_of("near", 200)), (None, words_of("near", 200) + " end"), (None, words_of("void", 200)), (None, words_of("void", 200) + " end"), (None, None), (22, words_of("pass", 60) + " " + words_of("tail", 50)), (None, words_of("pass", 60) + " " + words_of("none", 50)),
]


def brute_first(rows, k, percent):
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    sets = []
    for _, t in order:
        w = (t or "").lower().split()
        sets.append({tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set())
    root = list(range(len(order)))
    for a in range(len(order)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = [new if x == old else x for x in root]
    groups = collections.defaultdict(list)
    for r, g in zip(order, root):
        groups[g].append(r)
    return groups.values()


def test_rows_without_id_stay_through_the_stages(spark):
    docs = spark.createDataFrame(UNNAMED, "doc_id long, text string")
    rows = lambda df: [(r.doc_id, r.text) for r in df.collect()]
    once = rows(exact_dedup.keep_one(docs))
    by = collections.defaultdict(list)
    for i, t in UNNAMED:
        by[t or ""].append(i)
    assert collections.Counter((i, t or "") for i, t in once) == collections.Counter((min((i for i in g if i is not None), default=None), t) for t, g in by.items())
    once = spark.createDataFrame(once, "doc_id long, text string")
    first = rows(ngram_join.keep_first(once, 5, 80))
    groups = brute_first(rows(once), 5, 80)
    assert len(first) == len(groups)
    for g in groups:
        (r,) = [r for r in first if r in g]
        assert r[0] == g[0][0]
    cut = collections.Counter(rows(substring_dedup.without_repeats(spark.createDataFrame(first, "doc_id long, text string"), 50)))
    assert cut == collections.Counter((i, words_of("none", 50) if i is None and t and "none0" in t else t) for i, t in first)
    assert packing.pack(docs, byte_bpe()).where("doc_id IS NULL").count() > 0


def test_rows_of_one_id_with_different_texts_are_apart(spark):
    passage, other = words_of("pass", 60), words_of("other", 110)
    rows = [(1, passage + " " + words_of("a", 50)), (2, passage + " " + words_of("b", 50)), (2, other), (3, words_of("same", 60) + " " + words_of("c", 50)), (3, words_of("same", 60) + " " + words_of("d", 50))]
    got = [(r.doc_id, r.text) for r in substring_dedup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 50).collect()]
    assert sorted(got)[:3] == sorted([rows[0], (2, words_of("b", 50)), rows[2]])
    assert sorted(len(t.split()) for i, t in got if i == 3) == [50, 110]
    rows = [(1, words_of("near", 200)), (2, words_of("near", 200) + " end"), (2, other)]
    assert sorted((r.doc_id, r.text) for r in ngram_join.keep_first(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80).collect()) == [rows[0], rows[2]]


def test_repeats_compare_words_not_codes():
    words = substring_dedup.Words(pa.array("a b a b c d".split(), pa.large_string()))
    code, zero = np.zeros(3, np.uint64), np.zeros(3, np.int64)
    got = substring_dedup.repeats(code, zero, np.array([0, 2, 4]), np.array([0, 2, 4]), words, 2)
    assert got.tolist() == [False, True, False]


def test_word_codes_tell_words_apart():
    words = [f"{a}{b}" for a in "abcdefghijklmnop\x00\xe4" for b in [*map(str, range(3000)), "", "a" * 5000]]
    codes = wordcodes.word_codes(pa.array(words, pa.large_string()), 700)
    assert len(set(codes.tolist())) == len(words)
    assert (wordcodes.word_codes(pa.array(words, pa.large_string()).slice(5, 9)) == codes[5:14]).all()


def test_exact_dedup(odd):
    got = collections.Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(odd, "largest").collect())
    by = collections.defaultdict(list)
    for i, t in ODD:
        by[t or ""].append(i)
    want = collections.Counter((i, max(g), len(g), i == max(g)) for g in by.values() for i in g)
    assert got == want
    assert sorted(r.doc_id for r in exact_dedup.keep_one(odd).collect()) == sorted(min(g) for g in by.values())


def test_sharding_laws(spark, odd, docs):
    df = docs.select("doc_id", "text", "lang", "source").unionByName(odd.select("doc_id", "text", F.lit(None).cast("string").alias("lang"), F.lit("s").alias("source")))
    rows = sharding.shard_documents(df, 24, "rows").collect()
    counts = collections.Counter(r.shard for r in rows)
    assert max(counts.values()) - min(counts.values()) <= 1 and set(counts) == set(range(24))
    for law in sharding.LAWS:
        slots = collections.defaultdict(list)
        for r in sharding.shard_documents(df, 24, law).collect():
            slots[r.shard].append(r.slot)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    for r in sharding.shard_documents(odd.select("doc_id", "text", F.lit("x").alias("lang"), F.lit("s").alias("source")), 24).collect():
        raw = (dict(ODD)[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 8, zlib.crc32(raw))


@pytest.mark.parametrize("dims,bits", [(2, 4), (3, 3)])
def test_hilbert_neighbours(dims, bits):
    table = sharding.hilbert_numbers(dims, bits)
    cells = {h: [(c >> bits * d) & ((1 << bits) - 1) for d in range(dims)] for c, h in enumerate(table)}
    assert all(sum(abs(a - b) for a, b in zip(cells[h], cells[h + 1])) == 1 for h in range(len(table) - 1))


def test_warc_round_trip(spark, tmp_path):
    long = "payload " * 40
    pages = [(1, "u1", long), (2, "u2", long), (3, None, None), (4, "u\r\nx", ""), (5, "u5", "WARC/1.1\r\n\r\nWARC-Type: revisit\r\n\r\n" * 9), (6, "u6", "short"), (7, "u7", "short")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit(1))
    warc.archive(df, str(tmp_path / "a"))
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.records(spark, str(tmp_path / "a")).collect()}
    for i, _, h in pages:
        raw = (h or "").encode()
        assert got[i] == (len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if i == 2 else "response", 1 if i == 2 else None)
    for r in warc.reconstruct(spark, str(tmp_path / "a")).collect():
        head, body = bytes(r.record).split(b"\r\n\r\n", 1)
        length = int(re.search(rb"Content-Length: (\d+)", head)[1])
        assert body == bytes(r.payload)[:length] + b"\r\n\r\n"
    assert spark.read.parquet(str(tmp_path / "a" / "payloads")).count() == 4


def test_license_base_places(odd):
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for r in licenses.license_scan(odd).collect():
        w = word.findall((dict(ODD)[r.doc_id] or "").translate(lower))
        at = [(i, label) for p, label in licenses.BASE.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        assert r.n_words == len(w) and r.n_base == len(at) and r.base_labels == ",".join(sorted({x for _, x in at}))
        assert (r.first_word, r.last_word) == ((min(at)[0], max(at)[0]) if at else (None, None))
        assert {x for _, x in at} <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_license_containment(spark):
    text = "Released under the GNU General Public License version 3 or later. Licensed under the MIT license."
    (r,) = licenses.detections(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    kept = {h.label for h in r.hits if h.kept}
    assert {"gpl", "gpl-3.0", "mit"} <= kept
    # the plain name lies inside the versioned one
    assert not [h for h in r.hits if h.kept and h.label == "gpl" and h.priority == 1]
    assert not [h for h in r.hits if h.kept and h.label == "license-mention" and h.first > 10]


def examples(tree, rng):
    """A text that a parsed pattern matches, by chance."""
    out = ""
    for kind, arg in tree:
        name = str(kind)
        if name == "LITERAL":
            out += chr(arg)
        elif name == "SUBPATTERN":
            out += examples(arg[-1], rng)
        elif name == "BRANCH":
            out += examples(arg[1][rng.integers(len(arg[1]))], rng)
        elif name == "IN":
            kind, arg = arg[rng.integers(len(arg))]
            out += "x" if str(kind) == "NEGATE" else chr(arg if str(kind) == "LITERAL" else arg[0])
        elif name == "NOT_LITERAL":
            out += "x"
        else:
            assert name == "MAX_REPEAT", name
            out += "".join(examples(arg[2], rng) for _ in range(rng.integers(arg[0], min(int(arg[1]), arg[0] + 2) + 1)))
    return out


def test_license_gates_let_every_wording_pass(spark):
    rng, rows = np.random.default_rng(1), []
    for i, (_, _, gates, pattern) in enumerate(licenses.rules(licenses.BASE)):
        assert all(gates), pattern
        for text in {examples(re._parser.parse(pattern), rng) for _ in range(25)}:
            assert re.fullmatch(pattern, text)
            assert any(set(g) <= set(text.split()) for g in gates), (pattern, text)
            rows.append((i, text))
    found = licenses.detections(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "hits.rule").collect()
    assert len(found) == len(rows) and not [r.doc_id for r in found if r.doc_id not in r.rule]


@pytest.mark.parametrize("text,label", [
    ("Beerware License", "beerware"), ("0BSD", "bsd-0-clause"), ("our terms of service", "terms-of-use"), ("for personal use", "noncommercial"), ("for noncommercial use", "noncommercial"),
    ("for research purposes only", "academic-use"), ("Creative Commons Attribution-Share Alike 3.0", "cc-by-sa-3.0"), ("boost.org/LICENSE_1_0.txt", "boost-1.0"),
])
def test_license_wordings_without_a_keyword(spark, text, label):
    (r,) = licenses.license_scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert label in r.labels.split(",")


def test_fingerprints(odd, docs, texts):
    rows = sorted(((i, t or "") for i, t in ODD if i != 12), reverse=True)
    for df, pairs in ((odd.where("doc_id <> 12"), rows), (docs, sorted(texts.items(), reverse=True))):
        got = {r.doc_id: r for r in fingerprints.fingerprint_versions(df).collect()}
        prints = collections.defaultdict(set)
        for i, (doc, text) in enumerate(pairs):
            nxt = pairs[(i + 1) % len(pairs)][1]
            half = len(text) // 2
            new = text[: len(text) - half] + nxt[:half]
            r = got[doc]
            assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(new.encode()).hexdigest()

            def like(a, b):
                x, y = (set(fingerprints.paragraphs([t.encode()])[0].tolist()) for t in (a, b))
                return len(x & y) / len(x | y) if x | y else 1.0

            assert r.near_edited == pytest.approx(like(text, new)) and r.near_next == pytest.approx(like(text, nxt))
            prints[text].add(r.fingerprint)
        assert all(len(p) == 1 for p in prints.values())


def test_toxicity_on_held_out_labels(spark, data):
    sf = data.replace("sf0.001", "sf0.1")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    seen, held = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")
    chain = toxicity.train(docs, seen)
    rows = toxicity.score(docs, chain).join(held.withColumnRenamed("toxic", "y"), "doc_id").collect()
    bad, good = [r for r in rows if r.y == 1], [r for r in rows if r.y == 0]
    assert sum(r.toxic for r in bad) >= 0.85 * len(bad)
    assert sum(r.toxic for r in good) <= 0.01 * len(good)


def test_toxicity_without_labels(spark, odd, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.clean(odd, none).count() == len(ODD)


def test_empty_tables(spark, empty, data):
    assert bpe.round_trip(empty, byte_bpe()).count() == 0
    assert packing.pack(empty, byte_bpe()).count() == 0
    assert ngram_join.ngram_join(empty).count() == 0
    assert substring_dedup.substring_dedup(empty).count() == 0
    assert exact_dedup.exact_dedup(empty).count() == 0
    assert sharding.shard_documents(empty).count() == 0
    assert licenses.license_scan(empty).count() == 0
    assert fingerprints.fingerprint_versions(empty).count() == 0


def test_queries_and_pipeline_run(spark, data):
    import corpus_pipeline

    for name, q in QUERIES.items():
        assert q(spark, data).count() > 0, name
    columns = spark.read.parquet(f"{data}/documents.parquet").columns
    docs = spark.read.parquet(f"{data}/documents.parquet")
    before = docs.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, data)
        assert docs.columns == columns
        assert 0 < docs.count() <= before
    assert corpus_pipeline.run(spark, data).count() > 0


def test_scores_equal_plain_sums(spark, odd, docs):
    df = odd.select("doc_id", "text").unionByName(docs.select("doc_id", "text"))
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def names(text):
        words = set(re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(lower)))
        return words | {f"{w[:k]}~{k}" for w in words for k in toxicity.STEMS}

    rows = df.collect()
    every = sorted(set().union(*(names(r.text) for r in rows)))
    rng = np.random.default_rng(5)
    chain = []
    for i, (name, _) in enumerate(toxicity.CATEGORIES):
        chosen = [every[j] for j in sorted(rng.choice(len(every), 200, replace=False))]
        chain.append((name, float(rng.normal()), rng.normal(size=i).tolist(), chosen, rng.normal(size=200).tolist()))
    want = collections.defaultdict(list)
    for r in rows:
        has, p = names(r.text), []
        for _, constant, earlier, chosen, weights in chain:
            z = constant + sum(a * b for a, b in zip(p, earlier)) + sum(w for f, w in zip(chosen, weights) if f in has)
            p.append(1 / (1 + np.exp(-z)))
        want[r.doc_id].append(p)
    for r in toxicity.score(df, chain).collect():
        assert any(np.allclose([r[f"p_{name}"] for name, _ in toxicity.CATEGORIES], p) for p in want[r.doc_id])


def test_chain_is_fitted_out_of_fold():
    import pandas as pd

    rng = np.random.default_rng(2)
    features = [f"f{i}" for i in range(12)]
    hits = [[f for f in features if rng.random() < 0.4] for _ in range(240)]
    rows = pd.DataFrame({"fold": rng.integers(0, 3, 240), "hits": hits})
    for i, (name, _) in enumerate(toxicity.CATEGORIES):
        rows[f"y_{name}"] = [float((features[i] in h) ^ (rng.random() < 0.1)) for h in hits]
    chosen = {(name, k): features[: 10 + k] for name, _ in toxicity.CATEGORIES for k in range(-1, 3)}
    chain = toxicity.fit_chain(rows, chosen, 0.01)
    marks = lambda names: np.array([[float(f in h) for f in names] for h in hits])
    earlier = np.zeros((240, 0))
    for name, constant, before, names, weights in chain:
        y, x = rows[f"y_{name}"].to_numpy(), np.hstack([earlier, marks(names)])
        # the weights are where the penalised likelihood is level
        p = 1 / (1 + np.exp(-(x @ np.array([*before, *weights]) + constant)))
        level = x.T @ (p - y) / 240 + 0.01 * np.array([*before, *weights])
        assert np.abs(level).max() < 1e-4 and abs((p - y).mean()) < 1e-4
        held = np.zeros(240)
        for k in range(3):
            seen, fold_x = (rows["fold"] != k).to_numpy(), np.hstack([earlier, marks(chosen[name, k])])
            w = toxicity.fit_linear(fold_x[seen], y[seen], np.ones(seen.sum(), bool), 0.01)
            held[~seen] = (1 / (1 + np.exp(-(fold_x @ w[:-1] + w[-1]))))[~seen]
        earlier = np.hstack([earlier, held[:, None]])


def test_near_copies_and_passages_by_brute_force(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    first = sorted(r.doc_id for r in ngram_join.keep_first(docs, 5, 80).collect())
    assert first == sorted(g[0][0] for g in brute_first(rows, 5, 80))
    want = brute_passages(rows, 50)
    for r in substring_dedup.without_repeats(docs, 50).collect():
        n, gone, text = want[r.doc_id]
        assert r.text == (text if gone else dict(rows)[r.doc_id]) and r.n_chars == len(r.text or "")


def test_rows_of_one_id_keep_what_only_they_have(spark):
    a, b = words_of("a", 30), words_of("b", 30)
    got = sorted((r.doc_id, r.n_removed, r.kept_text) for r in substring_dedup.substring_dedup(spark.createDataFrame([(1, b), (2, a), (2, b), (None, b), (None, words_of("c", 25))], "doc_id long, text string"), 20).collect() if r.doc_id)
    assert got == [(1, 0, b), (2, 0, a), (2, 30, "")]


def test_warc_urls_with_line_ends(spark, tmp_path):
    ends = ["\u2028", "\u2029", "\x85", "\r\n", "\n", "\x0b", "\x0c"]
    pages = [(i, f"u{e}WARC-Refers-To: <urn:page:99>{e}WARC-Type: revisit", f"page {i} " * 40) for i, e in enumerate(ends)]
    pages += [(50, "x", "again " * 40), (50, "y", "again " * 40), (51, "z", "again " * 40), (None, "n", "again " * 40), (None, "n", "alone " * 40)]
    warc.archive(spark.createDataFrame(pages, "page_id long, url string, html string"), str(tmp_path / "u"))
    got = sorted(((r.page_id, r.record_type, r.refers_to) for r in warc.records(spark, str(tmp_path / "u")).collect()), key=str)
    want = [(i, "response", None) for i in range(len(ends))] + [(50, "response", None)] * 2 + [(51, "revisit", 50), (None, "revisit", 50), (None, "response", None)]
    assert got == sorted(want, key=str)


def test_license_scan_of_very_many_detections(spark):
    import time

    df = spark.createDataFrame([(1, "gpl license " * 20_000), (2, "all rights reserved " * 30_000)], "doc_id long, text string")
    began = time.time()
    got = {r.doc_id: r for r in licenses.license_scan(df).collect()}
    assert time.time() - began < 40
    assert got[1].n_words == 40_000 and "gpl" in got[1].labels and got[1].n_kept >= 20_000
    assert (got[2].n_base, got[2].first_word, got[2].last_word) == (30_000, 0, 89_997)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_match_their_sql(spark, data, name):
    import glob
    import os

    import duckdb

    c = duckdb.connect()
    for path in glob.glob(f"{data}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    want = c.execute(ORACLES[name])
    columns = [d[0] for d in want.description]
    got = QUERIES[name](spark, data)
    assert sorted(got.columns) == sorted(columns)
    assert collections.Counter(tuple(r) for r in got.select(columns).collect()) == collections.Counter(want.fetchall())
