"""Operator 10, toxicity by a chain of classifiers.

Categories are predicted one after the other; the probability of each earlier one is a feature of the later models, which are trained with
out-of-fold predictions of it, so that they learn how far to trust it. Models are logistic regressions over the presence of
chosen words and word beginnings and a few measures of the text. The chain of the query is low_quality, then toxic.

Training takes a bounded sample of labelled rows: about SAMPLE rows are expected, drawn by a hash of doc_id. Features are counted and
chosen in Spark, FEATURES at most, by chi-square for and against each category; the sample's rows reach the driver only as the numbers of
their chosen features. Null text is empty. Each category is learned from the rows with its own label, whatever the others are;
labels without a document, or with a null doc_id, are left out; where a document has several labels the greater holds. Without
labels every probability is 0. Repeated rows, and rows with a null doc_id, are scored like others. An empty table of documents gives an empty one.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import rows, staged, two

SAMPLE, FEATURES, FOLDS, LEAST = 8000, 4096, 5, 4
#: The chi-square of one degree of freedom that chance exceeds once in a thousand times.
CHANCE = 10.83
WORD = re.compile(r"[^\W\d_]+")
MEASURES = 4


def features_of(word: str) -> list[str]:
    """A word and its beginnings of four to six letters."""
    return ["=" + word, *(word[:k] for k in (4, 5, 6) if len(word) >= k)]


def measures(text: str, words: list[str], distinct: int) -> list[float]:
    """Shares of symbols, of capitals, of exclamation marks, and of words that occur before in the text."""
    n, w = max(1, len(text)), max(1, len(words))
    symbols = sum(map(text.count, "#*$%&|<>"))
    return [min(1.0, 4 * symbols / n), sum(x.isupper() for x in words) / w, min(1.0, 4 * text.count("!") / n), 1 - distinct / w]


@dataclass
class Chain:
    categories: list[str]
    columns: dict[str, int] = field(default_factory=dict)  # of chosen features
    weights: list[np.ndarray] = field(default_factory=list)  # features, measures, earlier probabilities, constant

    def probabilities(self, indices: list[np.ndarray], dense: np.ndarray) -> np.ndarray:
        """Rows by categories."""
        n, m = len(indices), len(self.columns)
        out = np.zeros((n, len(self.categories)))
        flat, row = (np.concatenate(indices), np.repeat(np.arange(n), [len(i) for i in indices])) if n else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        for c, w in enumerate(self.weights):
            z = np.bincount(row, w[flat], n) + dense @ w[m : m + MEASURES] + out[:, :c] @ w[m + MEASURES : -1] + w[-1]
            out[:, c] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return out


def fit_one(indices: list[np.ndarray], dense: np.ndarray, y: np.ndarray, m: int, steps: int = 250, rate: float = 0.1, decay: float = 1e-4) -> np.ndarray:
    """Weights of a logistic regression with balanced classes, by Adam over the whole sample."""
    n = len(y)
    flat, row = np.concatenate(indices), np.repeat(np.arange(n), [len(i) for i in indices])
    w = np.zeros(m + dense.shape[1] + 1)
    first, second = np.zeros_like(w), np.zeros_like(w)
    positive = min(max(y.sum(), 1), n)
    weight = np.where(y > 0, 0.5 / positive, 0.5 / max(1, n - positive))
    for t in range(1, steps + 1):
        z = np.bincount(row, w[flat], n) + dense @ w[m:-1] + w[-1]
        e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weight
        g = np.concatenate([np.bincount(flat, e[row], m), dense.T @ e, [e.sum()]]) + decay * w
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        w -= rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    return w


def fit_chain(categories: list[str], columns: dict[str, int], keys: np.ndarray, indices: list[np.ndarray], dense: np.ndarray, labels: np.ndarray) -> Chain:
    """Each model in turn, over the rows with its label (-1: none); what later models see of earlier ones are predictions for rows not trained on."""
    m, chain, fold = len(columns), Chain(categories, columns), keys % FOLDS
    for c in range(len(categories)):
        y, has = labels[:, c].astype(float), labels[:, c] >= 0
        if c + 1 < len(categories):
            oof = np.zeros(len(y))
            for f in range(FOLDS):
                train, test = np.flatnonzero((fold != f) & has), np.flatnonzero(fold == f)
                if not len(train) or not len(test):
                    continue
                part = fit_one([indices[i] for i in train], dense[train], y[train], m)
                some = [indices[i] for i in test]
                row = np.repeat(np.arange(len(test)), [len(i) for i in some])
                z = np.bincount(row, part[np.concatenate(some)], len(test)) + dense[test] @ part[m:-1] + part[-1]
                oof[test] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        mine = np.flatnonzero(has)
        if len(mine):
            chain.weights.append(fit_one([indices[i] for i in mine], dense[mine], y[mine], m))
        else:
            chain.weights.append(np.append(np.zeros(m + dense.shape[1]), -30.0))
        if c + 1 < len(categories):
            dense = np.column_stack([dense, oof])
    return chain


def _looked_up(columns: dict[str, int], cache: dict, texts: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """Each text's chosen features and measures; cache: of words, bounded by the caller."""
    indices, dense = [], np.zeros((len(texts), MEASURES))
    for d, t in enumerate(texts):
        words = WORD.findall(t)
        low = set(WORD.findall(t.lower()))
        got: set[int] = set()
        for w in low:
            k = cache.get(w)
            if k is None:
                k = cache[w] = tuple(columns[f] for f in features_of(w) if f in columns)
            if k:
                got.update(k)
        indices.append(np.array(sorted(got), np.int64))
        dense[d] = measures(t, words, len(low))
    return indices, dense


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, features: int = FEATURES, least: int = LEAST) -> Chain:
    """A chain from documents and labels (doc_id and a 0/1 column a category, in the order of the chain).

    sample: labelled documents expected in training; features: words and beginnings chosen at most, over all categories; least: documents
    that a feature must be in. Of several rows with one labelled doc_id the text first in order is learned from, so repeated rows don't
    enlarge what reaches the driver.
    """
    categories = [c for c in labels.columns if c != "doc_id"]
    y = labels.where("doc_id IS NOT NULL").where(F.coalesce(*categories).isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*[F.max(F.col(c)).cast("int").alias(c) for c in categories])
    total = y.count()
    if not total:
        return Chain(categories)
    share = min(1.0, sample / total)
    drawn = y.where(F.pmod(F.xxhash64("doc_id", F.lit(31)), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    label = F.array(*[F.coalesce(c, F.lit(-1)) for c in categories]).alias("y")  # -1: no label
    # about sample rows, written once: they are counted, measured and looked up
    rows_ = staged(two(docs).join(drawn, "doc_id").groupBy("doc_id", label).agg(F.min("text").alias("text")).select("doc_id", "text", "y"), "labelled")
    n_cat = len(categories)

    def tally(batches):
        seen: Counter = Counter()
        for batch in batches:
            for text, label in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                for f in {f for w in set(WORD.findall((text or "").lower())) for f in features_of(w)}:
                    seen[f, tuple(label)] += 1
        if seen:
            yield pa.RecordBatch.from_pylist([{"f": f, "n": [n * (x >= 0) for x in lab], "p": [n * (x > 0) for x in lab]} for (f, lab), n in seen.items()], schema=pa.schema([("f", pa.string()), ("n", pa.list_(pa.int64())), ("p", pa.list_(pa.int64()))]))

    counts = rows_.mapInArrow(tally, "f string, n array<long>, p array<long>").groupBy("f").agg(*[F.sum(F.get(x, F.lit(c))).alias(f"{x}{c}") for c in range(n_cat) for x in "np"])
    counts = staged(counts.where(functools.reduce(lambda a, b: a | b, [F.col(f"n{c}") >= least for c in range(n_cat)])), "features")  # each category chooses from them
    base = rows_.agg(*[F.count_if(F.get("y", F.lit(c)) >= 0).alias(f"n{c}") for c in range(n_cat)], *[F.count_if(F.get("y", F.lit(c)) > 0).alias(f"p{c}") for c in range(n_cat)]).collect()[0]
    chosen: dict[str, int] = {}
    for c in range(n_cat):
        p, n, a, b = F.col(f"p{c}").cast("double"), F.col(f"n{c}").cast("double"), float(base[f"p{c}"]), float(base[f"n{c}"])
        if not 0 < a < b:
            continue
        worth = b * (p * b - n * a) ** 2 / (n * (b - n) * a * (b - a))  # chi-square, for or against the category
        for r in counts.where((F.col(f"n{c}") >= least) & (F.col(f"n{c}") < b)).withColumn("worth", worth).where(F.col("worth") >= CHANCE).orderBy(F.desc("worth"), "f").limit(features // n_cat).select("f").collect():
            chosen.setdefault(r["f"], len(chosen))

    def looked_up(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                b = batch.slice(start, 500)
                indices, dense = _looked_up(chosen, {}, [t or "" for t in b.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([i.tolist() for i in indices], pa.list_(pa.int64())), pa.array(dense.tolist(), pa.list_(pa.float64()))], ["doc_id", "y", "i", "d"])

    got = sorted(rows_.mapInArrow(looked_up, "doc_id long, y array<int>, i array<long>, d array<double>").collect())  # about SAMPLE short rows
    if not got:
        return Chain(categories)
    return fit_chain(categories, chosen, np.array([g["doc_id"] for g in got]), [np.array(g["i"], np.int64) for g in got], np.array([g["d"] for g in got]), np.array([g["y"] for g in got]))


def scored(docs: DataFrame, chain: Chain, threshold: float = 0.5) -> DataFrame:
    """doc_id, p_<category> for each category, and toxic: whether the last one's probability is over the threshold."""
    names = ["doc_id", *(f"p_{c}" for c in chain.categories)]
    shared = docs.sparkSession.sparkContext.broadcast(chain)  # FEATURES words and as many weights a category

    def run(batches):
        c, cache = shared.value, {}
        for ids, texts in rows(batches):
            if len(cache) > 500_000:
                cache.clear()
            p = c.probabilities(*_looked_up(c.columns, cache, texts)) if c.weights else np.zeros((len(ids), len(c.categories)))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(p[:, k], pa.float64()) for k in range(p.shape[1]))], names)

    out = two(docs).mapInArrow(run, "doc_id long, " + ", ".join(f"{n} double" for n in names[1:]))
    return out.withColumn("toxic", F.col(names[-1]) > threshold)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return scored(docs, learn(docs, labels.select("doc_id", (1 - F.col("quality")).alias("low_quality"), F.col("toxic"))))
