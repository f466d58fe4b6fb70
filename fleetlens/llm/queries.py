"""The queries of the text operators, one for each, over whole tables; and the SQL that says the same."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm import bpe, exact_dedup, fingerprints, hard_negatives, host_quality, lexical_search, licenses, ngram_join, packing, sharding, substring_dedup, toxicity, warc
from fleetlens.llm.common import documents, shared_dir


def byte_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(documents(spark, sf_dir))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(documents(spark, sf_dir), byte_bpe())


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(documents(spark, sf_dir), k=3, percent=90)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.score(docs, toxicity.train(docs, documents(spark, sf_dir, "labels")))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), byte_bpe(), capacity=1024, end_id=0)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.substring_dedup(documents(spark, sf_dir), k=20)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir), keep="largest")


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_versions(documents(spark, sf_dir))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(documents(spark, sf_dir), shards=24, law="rows").withColumn("grown_shard", F.lit(None).cast("int"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.archive(documents(spark, sf_dir, "pages"), path, min_bytes=100)
    return warc.records(spark, path)


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.ranked_search(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"), k=50)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine_embeddings(documents(spark, sf_dir, "embeddings"))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_quality.judge(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_bpe": op2_bpe,
    "op3_ngram_join": op3_ngram_join,
    "op4_toxicity": op4_toxicity,
    "op5_packing": op5_packing,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_fingerprints": op8_fingerprints,
    "op9_sharding": op9_sharding,
    "op10_warc": op10_warc,
    "op11_ranked_search": op11_ranked_search,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_quality_rules": op13_quality_rules,
}

ORACLES: dict[str, str] = {
    "op6_substring_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        p AS (SELECT doc_id, w, unnest(range(0, len(w) - 19)) AS s FROM d WHERE len(w) >= 20),
        f AS (SELECT doc_id, s, row_number() OVER (PARTITION BY array_to_string(w[s + 1 : s + 20], ' ') ORDER BY doc_id, s) AS r FROM p),
        c AS (SELECT DISTINCT doc_id, s + o AS pos FROM f, range(20) t(o) WHERE r > 1),
        x AS (SELECT doc_id, unnest(w) AS word, unnest(range(0, len(w))) AS pos FROM d),
        k AS (SELECT x.doc_id, count(c.pos) AS n_removed, string_agg(CASE WHEN c.pos IS NULL THEN word END, ' ' ORDER BY x.pos) AS kept
              FROM x LEFT JOIN c ON x.doc_id = c.doc_id AND x.pos = c.pos GROUP BY x.doc_id)
        SELECT d.doc_id, CAST(len(w) AS bigint) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM d LEFT JOIN k ON d.doc_id = k.doc_id""",
    "op7_exact_dedup": """
        WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(text) AS text_sha256
        FROM t WINDOW w AS (PARTITION BY text)""",
    "op10_warc": """
        WITH t AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        f AS (SELECT *, octet_length(encode(html)) AS n, min(page_id) OVER (PARTITION BY html) AS first FROM t)
        SELECT page_id, n AS payload_bytes, sha256(html) AS payload_digest,
               CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to
        FROM f""",
    "op11_ranked_search": r"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
        q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
        c AS (SELECT CAST(count(*) FILTER (WHERE len(w) > 0) AS bigint) AS n_all, CAST(sum(len(w)) AS bigint) AS total FROM d),
        p AS (SELECT r, any_value(doc_id) AS doc_id, any_value(len(w)) AS n, term, count(*) AS tf FROM (SELECT r, doc_id, w, unnest(w) AS term FROM d) GROUP BY r, term),
        f AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(n_all) + 2 AS double) / (2 * count(*) + 1))) AS bigint) AS weight FROM p, c GROUP BY term),
        s AS (SELECT q.item_id, p.r, any_value(p.doc_id) AS doc_id, CAST(sum(f.weight * ((1000000000 * p.tf) // (1000 * p.tf + 20 * (50 + (50 * p.n * c.n_all) // c.total)))) AS bigint) AS score
              FROM q JOIN p ON q.term = p.term JOIN f ON q.term = f.term, c GROUP BY q.item_id, p.r),
        k AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS int) AS rank, doc_id, score FROM s WHERE score > 0)
        SELECT * FROM k WHERE rank <= 50""",
    "op12_hard_negatives": """
        WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS double))) AS v FROM embeddings
                   WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS bigint) AS score FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
        p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
        SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other) AS int) AS rank, s.other AS negative_id, p.positive_score, s.score AS negative_score
        FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
        QUALIFY rank <= 10""",
    "op13_quality_rules": r"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
                          list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
        p AS (SELECT r, unnest(range(1, len(w) - 6)) AS s, unnest(list_transform(range(1, len(w) - 6), lambda s: array_to_string(w[s : s + 7], ' '))) AS words FROM d WHERE len(w) > 8),
        t AS (SELECT r, s, count(*) OVER (PARTITION BY r, words) AS times FROM p),
        c AS (SELECT r, count(DISTINCT s + o) AS n_repeat_words FROM t, range(8) x(o) WHERE times > 1 GROUP BY r),
        j AS (SELECT d.r, doc_id, source, CAST(len(w) AS bigint) AS n_words, CAST(len(array_to_string(w, '')) AS bigint) AS word_chars, CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS bigint) AS n_symbols,
                     len(lines) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS bigint) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM d LEFT JOIN c ON d.r = c.r),
        f AS (SELECT *, n_words < 20 AS f_short, 100 * n_repeat_words > 30 * n_words AS f_repeats, 10 * n_symbols > n_words AS f_symbols, 10 * n_dup_lines > 3 * n_lines AS f_lines FROM j),
        h AS (SELECT source, rule, count(*) AS n, count(*) FILTER (WHERE failed) AS failed FROM (UNPIVOT f ON f_short, f_repeats, f_symbols, f_lines INTO NAME rule VALUE failed) WHERE source IS NOT NULL GROUP BY source, rule),
        m AS (SELECT rule, CAST(count(*) AS double) AS k, CAST(sum(n) AS double) AS n, CAST(sum(failed) AS double) AS f, CAST(sum(n * n) AS double) AS n2, sum(failed * failed / n) AS f2 FROM h GROUP BY rule),
        v AS (SELECT *, (f2 - f * f / n) / nullif(k - 1, 0) AS between_, (f - f2) / nullif(n - k, 0) AS inside, (n - n2 / n) / nullif(k - 1, 0) AS size FROM m),
        r AS (SELECT rule, f / n AS mean, (between_ - inside) / nullif(between_ + (size - 1) * inside, 0) AS alike FROM v),
        g AS (SELECT rule, mean, CASE WHEN alike > 0 THEN least(greatest(1 / alike - 1, 10), 1000) ELSE 1000 END AS strength FROM r),
        b AS (SELECT DISTINCT source FROM h JOIN g ON h.rule = g.rule WHERE (failed + mean * strength) / (n + strength) > 0.5)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, f_short OR f_repeats AS base_failed, b.source IS NOT NULL AS host_rejected,
               NOT (f_short OR f_repeats) AND b.source IS NULL AS kept
        FROM f LEFT JOIN b ON f.source = b.source""",
}
