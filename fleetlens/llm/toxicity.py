"""Toxicity by a classifier chain.

Categories are predicted one after the other; each linear model sees the words of a text and the probabilities of the
categories before it. For training those probabilities come from models of the other folds (out of fold), so that a
later model doesn't learn to trust an earlier one more than it may. A fold's model chooses its features without that
fold as well.

The labels table gives two judgements, so the chain is: low_quality (quality = 0), toxic_low_quality (both at once) and,
seeing the probabilities of these two, toxic (toxic = 1), which decides.

Features are the distinct lower-cased words of a text and the beginnings of its words. Spark counts them by category and
fold over the labelled sample and keeps the most telling (chi-square; ties by the feature's name) of each category, for
all folds and without each one; the models are fitted in one task on the sample, whose size is bounded by max_labelled
(the labelled documents of least id hash). Scoring reads every document whole: a batch's distinct words are looked up in
the table of kept features, and a text's sum takes each of its features once.

Null and empty texts have no words: their score is that of no features. Texts of any length are read whole. Rows that
repeat an id, or have none, are scored one by one; repeated labels count as often as they stand, labels that are null or
whose id is null not at all. Without labels, or where no labelled document is in the table, every probability is 0.5 and
nothing is called toxic. An empty table gives no rows. clean keeps all columns of its table, score the id alone.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from fleetlens.llm.common import renamed, ship_package, written
from fleetlens.llm.words import byte_table, split, tidy, translated

#: Name of each category, in chain order, and its condition on the labels. The last one decides.
CATEGORIES = (("low_quality", "quality = 0"), ("toxic_low_quality", "toxic = 1 AND quality = 0"), ("toxic", "toxic = 1"))
#: Letters of the word beginnings that count besides the words: they tell a word that is only met inflected or compounded.
STEMS = (4, 5)
#: ASCII characters of words; all others beyond ASCII belong to words too.
LETTERS = "0123456789abcdefghijklmnopqrstuvwxyz"
#: Texts whose words are looked up at once.
ROWS = 1000

#: One entry for each category: its name, the constant, the weights of earlier categories, features and weights.
Chain = list[tuple[str, float, list[float], list[str], list[float]]]


def names_of(word: str) -> list[str]:
    """The features that a word gives its text."""
    return [word, *(f"{word[:k]}~{k}" for k in STEMS)]


def _distinct(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct words of a batch, place of each word in them, row of each word)."""
    words, n = split(translated(texts, byte_table(words=LETTERS)))
    coded = words.dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False), np.repeat(np.arange(len(n)), n)


@F.arrow_udf(ArrayType(StringType()))
def features(texts: pa.Array) -> pa.Array:
    """The distinct features of each text."""
    words, place, row = _distinct(texts)
    index: dict[str, int] = {}
    table = np.array([[index.setdefault(f, len(index)) for f in names_of(w)] for w in words], np.int64).reshape(len(words), 1 + len(STEMS))
    pairs = np.unique(row[:, None] * max(1, len(index)) + table[place])
    ends = np.searchsorted(pairs, np.arange(len(texts) + 1) * max(1, len(index)))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(list(index), pa.string()).take(pa.array(pairs % max(1, len(index)))))


def fit_linear(x: np.ndarray, y: np.ndarray, seen: np.ndarray, penalty: float, rounds: int = 400) -> np.ndarray:
    """Logistic weights for the rows that are seen, the constant last, by accelerated gradient steps; the constant isn't penalised."""
    n = max(1, seen.sum())
    v, c = np.ones(x.shape[1]), 1.0
    for _ in range(20):
        size = np.sqrt(v @ v + c * c)
        out = seen * (x @ (v / size) + c / size)
        v, c = x.T @ out, out.sum()
    step = 1 / (0.25 * np.sqrt(v @ v + c * c) / n + penalty)
    w = z = np.zeros(x.shape[1] + 1)
    for i in range(rounds):
        off = seen * (_probability(x, z) - y) / n
        new = z - step * np.append(x.T @ off + penalty * z[:-1], off.sum())
        z = new + i / (i + 3) * (new - w)
        w = new
    return w


def _probability(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))


def fit_chain(rows: pd.DataFrame, chosen: dict[tuple[str, int], list[str]], penalty: float) -> Chain:
    """rows: fold, y_<category>, hits (chosen features that a document has). chosen: by category and left-out fold, -1 for none."""
    every = sorted({f for names in chosen.values() for f in names})
    place = {f: i for i, f in enumerate(every)}
    marks = np.zeros((len(rows), len(every)), bool)
    for i, hits in enumerate(rows["hits"]):
        marks[i, [place[h] for h in hits]] = True
    earlier = np.zeros((len(rows), 0))
    fold, out = rows["fold"].to_numpy(), []
    for name, _ in CATEGORIES:
        y = rows[f"y_{name}"].to_numpy(float)

        def x_of(left_out: int) -> np.ndarray:
            return np.hstack([earlier, marks[:, [place[f] for f in chosen.get((name, left_out), [])]]])  # noqa: B023

        w = fit_linear(x_of(-1), y, np.ones(len(rows), bool), penalty)
        n = earlier.shape[1]
        out.append((name, float(w[-1]), w[:n].tolist(), chosen.get((name, -1), []), w[n:-1].tolist()))
        # a document's probability comes from a model that hasn't seen it
        held = np.zeros(len(rows))
        for k in np.unique(fold):
            seen, x = fold != k, x_of(int(k))
            held[~seen] = _probability(x, fit_linear(x, y, seen, penalty))[~seen]
        earlier = np.hstack([earlier, held[:, None]])
    return out


def choose(seen: DataFrame, folds: int, most_features: int) -> dict[tuple[str, int], list[str]]:
    """The most telling features by category and left-out fold (-1: none), at most most_features in each direction. seen: fold, y_<category>, features."""
    names = [name for name, _ in CATEGORIES]
    parts = [("all", F.lit(True)), *((f"fold{k}", F.col("fold") == k) for k in range(folds))]
    sums = [F.sum(F.when(inside, value).otherwise(0.0)).alias(f"{what}_{part}") for part, inside in parts for what, value in (("n", F.lit(1.0)), *((name, F.col(f"y_{name}")) for name in names))]
    total = seen.agg(*sums).first()
    counted = seen.select("fold", *(f"y_{name}" for name in names), F.explode("features").alias("feature")).groupBy("feature").agg(*sums).where("n_all >= 3")
    rows = []
    for name in names:
        for left_out in range(-1, folds):
            rest = lambda what, of: of(f"{what}_all") - of(f"{what}_fold{left_out}") if left_out >= 0 else of(f"{what}_all")  # noqa: B023, E731
            n, yes = (float(rest(what, lambda c: total[c] or 0.0)) for what in ("n", name))
            # documents with the feature and the category, against what chance gives
            f, a = rest("n", F.col), rest(name, F.col)
            off = a * n - f * yes
            rows.append(F.struct(F.lit(name).alias("name"), F.lit(left_out).alias("left_out"), F.signum(off).alias("sign"), (off * off / (f * (n - f) * yes * (n - yes) + 1)).alias("chi")))
    # at most twice most_features for each category and fold come to the driver
    best = Window.partitionBy("name", "left_out", "sign").orderBy(F.desc("chi"), "feature")
    told = counted.select("feature", F.inline(F.array(*rows))).where("sign <> 0").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most_features)
    chosen: dict[tuple[str, int], list[str]] = {}
    for r in told.select("name", "left_out", "feature").collect():
        chosen.setdefault((r.name, r.left_out), []).append(r.feature)
    return {k: sorted(v) for k, v in chosen.items()}


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = 6000, folds: int = 3, most_features: int = 300, penalty: float = 0.0001, id_col: str = "doc_id", text_col: str = "text") -> Chain:
    """The chain; at most most_features for each category and direction."""
    ship_package(docs.sparkSession)
    targets = [F.expr(f"cast({condition} as double)").alias(f"y_{name}") for name, condition in CATEGORIES]
    known = labels.where("quality IS NOT NULL AND toxic IS NOT NULL AND doc_id IS NOT NULL").select(F.col("doc_id").alias("__id"), *targets)
    # a top-k: tasks pass on max_labelled rows at most
    sample = known.orderBy(F.xxhash64("__id"), "__id").limit(max_labelled)
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).join(F.broadcast(sample), "__id")
    columns = [F.pmod(F.xxhash64("__id", F.lit(7)), F.lit(folds)).cast("int").alias("fold"), *(F.col(f"y_{name}") for name, _ in CATEGORIES)]
    seen = written(rows.select(*columns, features("__text").alias("features")), "labelled")
    chosen = choose(seen, folds, most_features)
    every = sorted({f for names in chosen.values() for f in names})
    if not every:
        return [(name, 0.0, [0.0] * i, [], []) for i, (name, _) in enumerate(CATEGORIES)]

    @F.arrow_udf("array<string>")
    def among(lists: pa.Array) -> pa.Array:
        ends, words = lists.offsets.to_numpy(), lists.flatten()
        ok = pc.is_in(words, value_set=pa.array(every, pa.string()))
        upto = np.concatenate([[0], np.cumsum(ok.to_numpy(zero_copy_only=False))])
        return pa.ListArray.from_arrays(pa.array(upto[ends - ends[0]], pa.int32()), words.filter(ok))

    def fit(g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(fit_chain(g, chosen, penalty), columns=["name", "constant", "earlier", "features", "weights"])

    # one task, on max_labelled rows at most
    hits = seen.select("fold", *(f"y_{name}" for name, _ in CATEGORIES), among("features").alias("hits"))
    fitted = hits.groupBy(F.lit(0).alias("all")).applyInPandas(fit, "name string, constant double, earlier array<double>, features array<string>, weights array<double>").collect()
    by = {r["name"]: (r["name"], r["constant"], list(r["earlier"]), list(r["features"]), list(r["weights"])) for r in fitted}
    return [by[name] for name, _ in CATEGORIES]


def weight_sums(texts: pa.Array, index: dict[str, int], table: np.ndarray) -> np.ndarray:
    """For each text the sum of table's rows over its distinct features. index: row of each feature."""
    out = np.zeros((len(texts), table.shape[1]))
    for i in range(0, len(texts), ROWS):
        words, place, row = _distinct(texts.slice(i, ROWS))
        known = np.array([[index.get(f, -1) for f in names_of(w)] for w in words], np.int64).reshape(len(words), 1 + len(STEMS))
        told = (known >= 0).any(1)[place]
        has = np.zeros((len(out[i : i + ROWS]), len(table) + 1), bool)  # the last column takes what isn't known
        has[row[told, None], known[place[told]]] = True
        out[i : i + ROWS] = has[:, :-1] @ table
    tidy()
    return out


def scored(df: DataFrame, chain: Chain, text: Column, prefix: str = "p_") -> DataFrame:
    """df with a probability for each category; columns of these names give way to them. text reads df."""
    every = sorted({f for link in chain for f in link[3]})
    n = len(chain)
    weight = {f: [0.0] * n for f in every}
    for i, (_, _, _, names, weights) in enumerate(chain):
        for f, w in zip(names, weights):
            weight[f][i] = w
    columns = df.columns
    # the text goes along as a last column, and all of them under names that clash with none of these
    docs = df.select(*(F.col(f"`{c}`") for c in columns), text).toDF(*(f"c{i}" for i in range(len(columns) + 1)))
    df, text = docs, F.col(docs.columns[-1])
    if every:
        table, index = np.array([weight[f] for f in every]), {f: i for i, f in enumerate(every)}

        @F.arrow_udf("array<double>")
        def sums(texts: pa.Array) -> pa.Array:
            return pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * n, pa.int32()), pa.array(weight_sums(texts, index, table).ravel()))

        ship_package(df.sparkSession)
        df = df.withColumn("__sums", sums(text))
    else:
        df = df.withColumn("__sums", F.array(*[F.lit(0.0)] * n))
    done: list[str] = []
    for i, (name, constant, earlier, _, _) in enumerate(chain):
        logit = F.get("__sums", F.lit(i)) + F.lit(constant)
        for p, w in zip(done, earlier):
            logit = logit + F.col(p) * F.lit(w)
        df = df.withColumn(f"__p_{name}", 1 / (1 + F.exp(-logit)))
        done.append(f"__p_{name}")
    new = [f"{prefix}{name}" for name, *_ in chain]
    return df.select(*(F.col(plain).alias(c) for plain, c in zip(docs.columns[:-1], columns) if c not in new), *(F.col(p).alias(n) for p, n in zip(done, new)))


def score(docs: DataFrame, chain: Chain, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, p_<category>..., toxic) for every row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("__text"))
    return scored(rows, chain, F.col("__text")).withColumn("toxic", F.col(f"p_{CATEGORIES[-1][0]}") > threshold).drop("__text")


def clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **settings) -> DataFrame:
    """The rows of docs, all columns, that aren't toxic."""
    chain = train(docs, labels, **settings)
    docs, name, back = renamed(docs)
    return back(scored(docs, chain, F.col(name["text"])).where(F.col(f"p_{CATEGORIES[-1][0]}") <= threshold))
