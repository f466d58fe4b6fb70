"""Stages keep a table's columns, whatever their names; settings of the session stay as they are."""

import pytest
from pyspark.sql import functions as F

from fleetlens.llm import exact_dedup, ngram_join, substring_dedup, toxicity

#: Names that the operators use inside, or give out.
NAMES = [
    "__id", "__runs", "__tie", "__cut", "__sums", "__p_toxic", "__p_low_quality", "p_toxic", "__shared", "__number", "__bits", "__stays", "__row", "__text", "__hash", "__sha", "__keep", "hash128", "text_sha256",
    "keep_id", "group_size", "g_hash", "g_sha", "c0", "c1", "c9", "doc_id_", "component_id", "a b", "x.y", "runs", "label", "words",
]
PASSAGE = " ".join(f"p{i}" for i in range(60))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, len(t)) for i, t in enumerate([f"{PASSAGE} one", f"start {PASSAGE} two words", "same text", "same text", "other " * 9, " ".join(f"n{i}" for i in range(40)), " ".join(f"n{i}" for i in range(40)) + " more"])]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    return df.select("*", *(F.concat(F.lit(f"{n}:"), F.col("doc_id").cast("string")).alias(n) for n in NAMES))


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, int(i in (2, 3))) for i in range(7)], "doc_id long, quality int, toxic int")


STAGES = {
    "exact": lambda d, _: exact_dedup.keep_one(d),
    "near": lambda d, _: ngram_join.keep_first(d, k=3, percent=80),
    "passages": lambda d, _: substring_dedup.without_repeats(d, k=50),
    "toxicity": lambda d, labels: toxicity.clean(d, labels),
}


@pytest.mark.parametrize("stage", STAGES)
def test_stages_keep_every_column(spark, docs, labels, stage):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    out = STAGES[stage](docs, labels)
    assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
    got, plain = out.collect(), STAGES[stage](docs.select("doc_id", "text", "n_chars"), labels).collect()
    assert sorted((r["doc_id"], r["text"], r["n_chars"]) for r in got) == sorted(tuple(r) for r in plain)
    for r in got:
        assert all(r[n] == f"{n}:{r['doc_id']}" for n in NAMES)
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
    if stage == "passages":
        assert {r["doc_id"]: r["text"] for r in got}[1] == "start two words"
    if stage in ("exact", "near"):
        assert 0 < len(got) < 7


def test_scores_beside_columns_of_their_names(spark, docs, labels):
    chain = toxicity.train(docs, labels)
    out = toxicity.scored(docs, chain, F.col("text"))
    assert [c for c in out.columns if c not in docs.columns] == ["p_low_quality", "p_both"] or "p_toxic" in out.columns
    r = out.first()
    assert all(r[n] == f"{n}:{r['doc_id']}" for n in NAMES if not n.startswith("p_")) and isinstance(r["p_toxic"], float)
