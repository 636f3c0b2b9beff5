"""Toxicity by a chain of linear classifiers, each fed the probabilities of those before it."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.sampling import picked, share_of
from marketloom.session import materialize

#: The chain, in order: a category's name and the label value that means it.
CHAIN = (("low_quality", "quality", 0), ("toxic", "toxic", 1))
#: Labelled rows to fit on, an expected number; words per category; folds; ridge penalty; documents a word must be in.
ROWS, WORDS, FOLDS, RIDGE, MIN_DOCS = 6000, 224, 5, 0.2, 4
WORD = re.compile(r"[^\W\d_]+")
#: Lengths of the word beginnings that are features too: languages that compound and inflect share stems, not words.
STEMS = (4, 5, 6, 7)
#: Probability of the last category above which a document is flagged.
THRESHOLD = 0.5


def words_in(text: str | None) -> set[str]:
    return set(WORD.findall((text or "").lower()))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE, steps: int = 12) -> np.ndarray:
    """Weights (last: intercept) of a ridge logistic regression, by Newton's method. One class only gives a constant."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    rate = (y.sum() + 0.5) / (len(y) + 1)
    w[-1] = np.log(rate / (1 - rate))
    if len(set(y.tolist())) < 2:
        return w
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = sigmoid(x @ w)
        step = np.linalg.solve((x.T * (p * (1 - p) + 1e-9)) @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += step * min(1.0, 8 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-4:
            break
    return w


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


@dataclass
class Chain:
    """words: column of each word; weights: per category, over words, then earlier categories, then the intercept."""

    names: list[str]
    words: dict[str, int]
    weights: list[np.ndarray]

    def features(self, sets: list[set[str]]) -> np.ndarray:
        """Of sets of plain words: which of the chain's words and stems each holds."""
        x = np.zeros((len(sets), len(self.words)))
        stems = {n: {w[:-1]: i for w, i in self.words.items() if w[-1] == "-" and len(w) == n + 1} for n in STEMS}
        for k, s in enumerate(sets):
            x[k, [self.words[w] for w in self.words.keys() & s]] = 1.0
            for n, own in stems.items():
                x[k, [own[w] for w in own.keys() & {w[:n] for w in s if len(w) > n}]] = 1.0
        return x

    def predict(self, x: np.ndarray) -> np.ndarray:
        done = np.zeros((len(x), 0))
        for w in self.weights:
            p = sigmoid(np.hstack([x, done]) @ w[:-1] + w[-1])
            done = np.hstack([done, p[:, None]])
        return done


def labelled(docs: DataFrame, labels: DataFrame, chain: tuple, rows: int) -> DataFrame:
    """_id, _text, _y0, _y1, ... of about ``rows`` labelled documents, chosen by a hash of the id; that bound is also why their
    labels are broadcast. A document labelled twice has a category if one of its labels says so."""
    known = labels.where(F.col("doc_id").isNotNull())
    for _, column, _ in chain:
        known = known.where(F.col(column).isNotNull())
    known = known.groupBy("doc_id").agg(*[F.max((F.col(c) == v).cast("double")).alias(f"_y{k}") for k, (_, c, v) in enumerate(chain)])
    known = known.where(picked(share_of(rows, labels.count()), "doc_id", F.lit("labels"))).withColumnRenamed("doc_id", "_id")
    return docs.select("doc_id", F.col("text").cast("string").alias("_text")).join(F.broadcast(known), F.col("doc_id") == F.col("_id")).drop("doc_id")


def pick_words(known: DataFrame, categories: int, most: int = WORDS, min_docs: int = MIN_DOCS) -> list[str]:
    """For each category the ``most`` words and stems (marked by a hyphen) whose presence differs most between its documents and
    the others, in standard errors. Spark counts them; the driver gets the chosen ones."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("_text"), F.lit(r"(\p{L}+)"), 1))
    stem = lambda n: F.transform(F.filter(F.col("_w"), lambda w: F.length(w) > n), lambda w: F.concat(F.substring(w, 1, n), F.lit("-")))
    ys = [f"_y{k}" for k in range(categories)]
    own = known.select(words.alias("_w"), *ys).select(F.explode(F.array_distinct(F.concat("_w", *[stem(n) for n in STEMS]))).alias("word"), *ys)
    counts = own.groupBy("word").agg(F.count(F.lit(1)).alias("n"), *[F.sum(y).alias(y) for y in ys]).where(F.col("n") >= min_docs)
    total = known.agg(F.count(F.lit(1)).alias("n"), *[F.sum(y).alias(y) for y in ys]).first()
    chosen: set[str] = set()
    for y in ys if total["n"] else []:
        rate, share = F.col("n") / total["n"], (total[y] or 0.0) / total["n"]
        z = F.abs(F.col(y) - total[y] * rate) / F.sqrt(F.greatest(total[y] * (1 - share) * rate * (1 - rate), F.lit(1e-9)))
        chosen |= {r["word"] for r in counts.orderBy(z.desc(), "word").limit(most).select("word").collect()}
    return sorted(chosen)


def fit_chain(ids: list[int], x: np.ndarray, labels: np.ndarray, names: list[str], words: dict[str, int], folds: int = FOLDS, ridge: float = RIDGE) -> Chain:
    """Later models are trained on out-of-fold probabilities of earlier ones: each comes from a model that has not seen its row."""
    chain = Chain(names, words, [])
    fold = np.array([(i * 2654435761 >> 7) % folds for i in ids])
    done = np.zeros((len(ids), 0))
    for k in range(len(names)):
        have, out = np.hstack([x, done]), np.zeros(len(ids))
        for f in range(folds if k + 1 < len(names) else 0):
            own = fold == f
            w = logistic(have[~own], labels[~own, k], ridge) if (~own).any() else np.zeros(have.shape[1] + 1)
            out[own] = sigmoid(have[own] @ w[:-1] + w[-1])
        chain.weights.append(logistic(have, labels[:, k], ridge))
        done = np.hstack([done, out[:, None]])
    return chain


def train(docs: DataFrame, labels: DataFrame, chain: tuple = CHAIN, rows: int = ROWS) -> Chain:
    """Fits the chain; of each labelled document the driver gets the numbers of the chosen words that it holds. The documents are read
    once: the chosen ones, bounded by ``rows``, are written and reread for each count."""
    known, names = materialize(labelled(docs, labels, chain, rows), "labelled"), [n for n, *_ in chain]
    words = {w: k for k, w in enumerate(pick_words(known, len(chain)))}
    empty = Chain(names, words, [])

    def found(batches):
        for b in batches:
            x = empty.features([words_in(t) for t in b.pop("_text")])
            yield b.assign(_x=[np.flatnonzero(r).astype("int32") for r in x])

    ys = [f"_y{k}" for k in range(len(chain))]
    rows_in = known.mapInPandas(found, f"_id long, {', '.join(f'{y} double' for y in ys)}, _x array<int>").collect()
    rows_in.sort(key=lambda r: r["_id"])
    x = np.zeros((len(rows_in), len(words)))
    for k, r in enumerate(rows_in):
        x[k, r["_x"]] = 1.0
    y = np.array([[r[c] for c in ys] for r in rows_in]).reshape(len(rows_in), len(chain))
    return fit_chain([r["_id"] for r in rows_in], x, y, names, words)


def predict(docs: DataFrame, model: Chain, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, p_<category> of each category of the chain, and whether the last one's is above ``threshold`` (named after it).

    Null and empty texts are scored as texts without words; null ids and repeated rows come back each, equal texts with equal
    results; extra columns are ignored; a text of any length is taken whole, as the set of its words; with no labelled row every
    probability is the same one half, and nothing is flagged. An empty table gives an empty one.
    """
    names = [f"p_{n}" for n in model.names]
    last = model.names[-1]

    def run(batches):
        for b in batches:
            p = model.predict(model.features([words_in(t) for t in b.column("text").to_pylist()]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(p[:, k]) for k in range(len(names))), pa.array(p[:, -1] > threshold)], ["doc_id", *names, last])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id long, {', '.join(f'{n} double' for n in names)}, {last} boolean")


def op5_toxicity_chain(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return predict(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


QUERIES = {"op5_toxicity_chain": op5_toxicity_chain}
SQL: dict[str, str] = {}
