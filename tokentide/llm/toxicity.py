"""Toxicity: severity grades by cumulative-link ordinal regression.

Features are the words of a document and their beginnings of four, five and six
characters, counted (log(1 + n)). Grade 0 is a document labelled not toxic; toxic
ones have grades 1 to 3 by thirds of their number of words with a chosen feature.
One weight vector serves all thresholds: P(grade <= k) = logistic(t_k - w x). The
result is the expected grade.

The model is fitted on a bounded sample of labelled rows: the ``TOXIC_DOCS`` toxic
and ``CLEAN_DOCS`` other ones with the least hashed ids, weighted to the labels'
own proportions; copies count once. Features are chosen by the likelihood-ratio statistic of the
sample, at most ``FEATURES`` of them, and only where it is beyond what chance gives
among so many candidates. Every document is scored, whole.

Words: lower-cased runs of letters. Defined cases: a null or empty text has no
features and gets the grade that the thresholds give an empty document; a null
doc_id has no label; documents with several labels count as toxic if one says so;
without a toxic label nothing is toxic; repeated rows get a row each; an empty
table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, StructField

from ..session import staged
from .common import least_hashed, per_document, slabs, texts_of

#: Labelled documents that the model is fitted on, at most.
TOXIC_DOCS = 4_000
CLEAN_DOCS = 8_000
FEATURES = 512
GRADES = 4
STEPS = 400
SHRINK = 2e-5
BEGINNINGS = (4, 5, 6)
#: Words whose features a worker keeps.
CACHED = 1_000_000

_WORD = re.compile(r"[^\W\d_]+")


def features_of(word: str) -> list[str]:
    return [word, *(word[:n] + "*" for n in BEGINNINGS if len(word) > n)]


def words_of(text: bytes) -> list[str]:
    return _WORD.findall(text.decode("utf-8", "replace").lower())


def sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, toxic, weight) of the documents to learn from, stored; its size is bounded."""
    marks = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marks = staged(marks, "toxicity-labels")
    chosen = None
    for toxic, limit in ((1, TOXIC_DOCS), (0, CLEAN_DOCS)):
        own = marks.where(F.col("toxic") == toxic)
        weight = max(1.0, own.count() / limit)
        part = least_hashed(own, limit).withColumn("weight", F.lit(weight))
        chosen = part if chosen is None else chosen.unionByName(part)
    # at most TOXIC_DOCS + CLEAN_DOCS rows of three numbers
    known = docs.select("doc_id", "text").join(F.broadcast(staged(chosen, "toxicity-chosen")), "doc_id")
    # copies of one text would make all its words look like signs: the least hash of its word triples stands for it
    words = F.split(F.lower("text"), r"\s+")
    triples = F.transform(F.arrays_zip(words, F.slice(words, 2, 1 << 30), F.slice(words, 3, 1 << 30)), lambda t: F.xxhash64(t))
    once = known.where("text is not null").withColumn("least", F.array_min(triples)).groupBy("toxic", "least")
    return staged(once.agg(F.min(F.struct("doc_id", "text", "weight")).alias("row")).select("row.*", "toxic"), "toxicity-sample")


def choose(known: DataFrame) -> list[str]:
    """Features that say most for toxic, by the likelihood-ratio statistic of document counts."""

    def run(batches):
        counts = (Counter(), Counter())
        for part in slabs(batches):
            for text, toxic in zip(texts_of(part), part.column("toxic").to_pylist(), strict=True):
                counts[int(toxic == 1)].update({f for w in set(words_of(text)) for f in features_of(w)})
        for n, own in enumerate(counts):
            names = list(own)
            for at in range(0, len(names), 1 << 16):
                part = names[at : at + (1 << 16)]
                yield pa.RecordBatch.from_pydict({"feature": part, "toxic": [n] * len(part), "n": [own[f] for f in part]}, schema=schema)

    schema = pa.schema([("feature", pa.string()), ("toxic", pa.int32()), ("n", pa.int64())])
    total = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    bad, good = total.get(1, 0), total.get(0, 0)
    if not bad:
        return []
    counted = known.select("text", "toxic").mapInArrow(run, "feature string, toxic int, n bigint").groupBy("feature")
    both = counted.agg(F.sum(F.expr("if(toxic = 1, n, 0)")).alias("a"), F.sum(F.expr("if(toxic = 1, 0, n)")).alias("b"))
    a, b, n = F.col("a"), F.col("b"), float(bad + good)
    term = lambda seen, expected: F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)
    statistic = 2 * (
        term(a, (a + b) * (bad / n)) + term(b, (a + b) * (good / n)) + term(bad - a, (n - a - b) * (bad / n)) + term(good - b, (n - a - b) * (good / n))
    )
    both = staged(both, "toxicity-features")
    # of n features without a meaning, about n * exp(-g / 2) reach a statistic of g by chance
    beyond = 2 * math.log(both.count() + 1)
    ranked = both.where(a * good > b * bad).withColumn("g", statistic).where(F.col("g") >= beyond)
    return [r.feature for r in ranked.orderBy(F.desc("g"), "feature").limit(FEATURES).collect()]


class Vectors:
    """Sparse rows (feature numbers and values) of texts."""

    def __init__(self, chosen: list[str]):
        self.number = {f: i for i, f in enumerate(chosen)}
        self.cache: dict[str, tuple[int, ...]] = {}

    def of(self, text: bytes) -> tuple[list[int], list[float], int]:
        """Numbers and values, and how many words have a chosen feature."""
        counts: Counter = Counter()
        marked = 0
        if len(self.cache) > CACHED:
            self.cache.clear()
        for word, n in Counter(words_of(text)).items():
            own = self.cache.get(word)
            if own is None:
                own = self.cache[word] = tuple(self.number[f] for f in features_of(word) if f in self.number)
            if own:
                marked += n
                for i in own:
                    counts[i] += n
        return list(counts), [math.log1p(n) for n in counts.values()], marked


@dataclass
class Ordinal:
    chosen: list[str]
    weights: np.ndarray
    thresholds: np.ndarray

    def grades(self, scores: np.ndarray) -> np.ndarray:
        """Probability of each grade by row."""
        upto = 1 / (1 + np.exp(-np.clip(self.thresholds[None, :] - scores[:, None], -40, 40)))
        return np.diff(upto, axis=1, prepend=0.0, append=1.0)


def fit_ordinal(number: np.ndarray, value: np.ndarray, row: np.ndarray, grade: np.ndarray, weight: np.ndarray, n_features: int, n_grades: int = GRADES):
    """Weights and rising thresholds of a cumulative-link (logistic) model, by Adam on all rows.

    ``number``, ``value``, ``row``: the entries of the sparse rows. Thresholds are a
    first one and the logarithms of the steps between them, so they stay in order.
    """
    n = len(grade)
    share = weight / weight.sum()
    theta = np.zeros(n_features + n_grades - 1)
    theta[n_features] = 1.0
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    logistic = lambda x: 1 / (1 + np.exp(-np.clip(x, -40, 40)))
    for step in range(1, STEPS + 1):
        w, gaps = theta[:n_features], np.exp(np.clip(theta[n_features + 1 :], -10, 10))
        cuts = np.concatenate(([-np.inf, theta[n_features]], theta[n_features] + np.cumsum(gaps), [np.inf]))
        score = np.bincount(row, weights=w[number] * value, minlength=n)
        low, high = logistic(cuts[grade] - score), logistic(cuts[grade + 1] - score)
        inside = np.maximum(high - low, 1e-12)
        slope_low, slope_high = low * (1 - low) / inside, high * (1 - high) / inside
        by_score = share * (slope_high - slope_low)  # of the negative log-likelihood
        by_cut = np.bincount(grade, weights=share * slope_low, minlength=n_grades + 1) - np.bincount(grade + 1, weights=share * slope_high, minlength=n_grades + 1)
        by_cut = by_cut[1:n_grades]
        gradient = np.concatenate(
            (
                np.bincount(number, weights=by_score[row] * value, minlength=n_features) + SHRINK * w,
                [by_cut.sum()],
                np.cumsum(by_cut[::-1])[::-1][1:] * gaps,
            )
        )
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        theta -= 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    cuts = theta[n_features] + np.concatenate(([0.0], np.cumsum(np.exp(np.clip(theta[n_features + 1 :], -10, 10)))))
    return theta[:n_features], cuts


def fit(docs: DataFrame, labels: DataFrame) -> Ordinal:
    known = sample(docs, labels)
    chosen = choose(known)
    never = Ordinal([], np.zeros(0), np.full(GRADES - 1, 40.0))
    if not chosen:
        return never

    def run(batches):
        vectors = Vectors(chosen)
        for part in slabs(batches):
            made = [vectors.of(t) for t in texts_of(part)]
            columns = {"number": [m[0] for m in made], "value": [m[1] for m in made], "marked": [m[2] for m in made]}
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns.values(), schema, strict=False)] + [part.column("toxic"), part.column("weight")], schema=schema)

    schema = pa.schema([("number", pa.list_(pa.int32())), ("value", pa.list_(pa.float64())), ("marked", pa.int64()), ("toxic", pa.int32()), ("weight", pa.float64())])
    made = "number array<int>, value array<double>, marked bigint, toxic int, weight double"
    typed = known.select("text", F.col("toxic").cast("int").alias("toxic"), "weight").mapInArrow(run, made)
    rows = typed.collect()  # one short sparse row for each document of the sample
    toxic = np.array([r.toxic == 1 for r in rows])
    marked = np.array([r.marked for r in rows])
    cuts = np.quantile(marked[toxic], [1 / 3, 2 / 3])
    grade = np.where(toxic, 1 + np.searchsorted(cuts, marked, side="left"), 0)
    number = np.array([i for r in rows for i in r.number], dtype=np.int64)
    value = np.array([v for r in rows for v in r.value])
    row = np.repeat(np.arange(len(rows)), [len(r.number) for r in rows])
    weights, thresholds = fit_ordinal(number, value, row, grade, np.array([r.weight for r in rows]), len(chosen))
    return Ordinal(chosen, weights, thresholds)


def severity(docs: DataFrame, model: Ordinal) -> DataFrame:
    """doc_id, severity (expected grade), grade (most likely), p_toxic (of grade 1 or more) and toxic of every row."""
    fields = [StructField("severity", DoubleType(), False), StructField("grade", IntegerType(), False)]
    fields += [StructField("p_toxic", DoubleType(), False), StructField("toxic", BooleanType(), False)]
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        own = sent.value
        vectors = Vectors(own.chosen)

        def score(batch):
            made = [vectors.of(t) for t in texts_of(batch)]
            p = own.grades(np.array([sum(own.weights[i] * v for i, v in zip(m[0], m[1], strict=True)) for m in made], dtype=float))
            bad = 1 - p[:, 0]
            return [p @ np.arange(p.shape[1]), p.argmax(axis=1), bad, bad >= 0.5]

        return score

    return per_document(docs, fields, start)
