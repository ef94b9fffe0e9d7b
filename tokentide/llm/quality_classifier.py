"""Quality classifier: random Fourier features, ridge regression, isotonic calibration.

A document is described by statistics of its whole text. Random Fourier features
approximate a Gaussian kernel over the standardised statistics; each task adds up
its labelled rows' normal equations, a fixed number of sums meets on the driver,
and ridge regression is solved there. Raw scores become probabilities by isotonic
regression over ``BINS`` bins of scores. The scores it is fitted on come from the
half of the labelled rows that the weights were not fitted on (two folds).

One pass over the texts stores the statistics, a few numbers a document; labels are
joined to those, never to texts. All labelled rows outside of the held-out third are
used; a row is held out if crc32 of its doc_id as text is 1 modulo 3.

Defined cases: a null or empty text has statistics of an empty text and is scored; a
null doc_id has no label and is not held out; a document with several labels counts
with each; repeated rows count each; without labels, or with one class only, every
score is the share of label 1 (0.5 without labels); an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField

from ..session import staged
from . import textstats
from .common import WordIds, keep_documents, per_document, texts_of

FEATURES = 192
#: Width of the kernel, in standard deviations of the statistics.
WIDTH = 6.0
RIDGE = 1e-3
BINS = 2048
SEED = 20
#: Tasks that add up the sums of all tasks before them.
SUMS = 12
CUT = 0.5
_RANGE = 4.0  # statistics are cut to so many deviations

_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123))
_DIGITS = bytes(range(48, 58))
_MARKS = bytes(b for b in range(33, 127) if b not in _LETTERS + _DIGITS)


def _count(text: bytes, chars: bytes) -> int:
    return len(text) - len(text.translate(None, chars))


def statistics(texts: list[bytes]) -> np.ndarray:
    """A row of numbers for each text."""
    documents = [t.split() for t in texts]
    words = WordIds(documents)
    n = np.maximum(words.lengths, 1)
    repeated = textstats.repeated_words(words)
    distinct, most = textstats.distinct_words(words)
    again = np.zeros(len(words.ids), dtype=bool)
    if len(words.ids):
        again[1:] = (words.ids[1:] == words.ids[:-1]) & (words.document[1:] == words.document[:-1])
    neighbours = np.bincount(words.document, weights=again, minlength=len(texts))
    ending = np.array([0, *(not (w[-1] >= 128 or 48 <= w[-1] <= 57 or 65 <= w[-1] <= 90 or 97 <= w[-1] <= 122) for w in words.number)], dtype=bool)
    marked = np.bincount(words.document, weights=ending[words.ids], minlength=len(texts))
    rows = []
    for text, k, own in zip(texts, n.tolist(), documents, strict=True):
        size, letters = max(len(text), 1), max(_count(text, _LETTERS), 1)
        lines, same = textstats.duplicate_lines(text)
        chars = textstats.word_chars(text)
        rows.append(
            (
                np.log1p(len(own)),
                np.log1p(chars / k),
                _count(text, _UPPER) / letters,
                _count(text, _DIGITS) / size,
                _count(text, _MARKS) / size,
                textstats.symbols(text) / k,
                text.count(b"!") / k,
                text.count(b"|") / k,
                same / max(lines, 1),
                np.log1p(len(own) / max(lines, 1)),
                _count(text, bytes(range(128, 256))) / size,
            )
        )
    by_words = np.stack((repeated / n, np.log(np.maximum(distinct, 1)) / np.log(n + 1), most / n, neighbours / n, marked / n), axis=1)
    return np.concatenate((np.array(rows, dtype=float).reshape(len(texts), -1), by_words), axis=1)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def _fold(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(2)).cast("int")


@dataclass
class Model:
    mean: np.ndarray
    deviation: np.ndarray
    weights: np.ndarray
    edges: np.ndarray
    levels: np.ndarray

    @staticmethod
    def directions(n: int) -> tuple[np.ndarray, np.ndarray]:
        random = np.random.default_rng(SEED)
        return random.standard_normal((n, FEATURES)) / WIDTH, random.uniform(0, 2 * np.pi, FEATURES)

    def features(self, stats: np.ndarray) -> np.ndarray:
        """cos(Wx + b) and a constant."""
        scaled = np.clip((stats - self.mean) / self.deviation, -_RANGE, _RANGE)
        w, b = self.directions(stats.shape[1])
        made = np.ones((len(stats), FEATURES + 1))
        made[:, :-1] = np.sqrt(2 / FEATURES) * np.cos(scaled @ w + b)
        return made

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(self.features(stats) @ self.weights, -0.5, 1.5)

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(stats), self.edges, self.levels)


def isotonic(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Non-decreasing least-squares fit of means with their counts (pool adjacent violators)."""
    pools: list[list[float]] = []
    for value, count in zip(values.tolist(), counts.tolist(), strict=True):
        pools.append([value, count, 1])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            b, a = pools.pop(), pools.pop()
            total = a[1] + b[1]
            pools.append([(a[0] * a[1] + b[0] * b[1]) / total, total, a[2] + b[2]])
    return np.concatenate([np.full(int(k), v) for v, _, k in pools]) if pools else np.zeros(0)


def _solve(sums: np.ndarray) -> np.ndarray:
    """Ridge weights from the rows of [Z y]'[Z y]; the constant is not shrunk."""
    gram, moment = sums[:-1, :-1], sums[:-1, -1]
    shrink = RIDGE * gram[-1, -1] * np.eye(len(gram))
    shrink[-1, -1] = 1e-9
    return np.linalg.solve(gram + shrink, moment)


def _partition_sums(rows: DataFrame, terms) -> np.ndarray:
    """Sum of ``terms(stats, y, fold)``, an array a batch, over all rows.

    Rows are added up where they are, an array for each task; those meet in SUMS tasks, an
    array of which each goes to the driver.
    """

    def packed(total: np.ndarray | None):
        if total is not None:
            yield pa.RecordBatch.from_pydict({"total": pa.array([total.tobytes()], pa.binary())})

    def run(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                width = len(batch.column("stats")[0])
                stats = batch.column("stats").flatten().to_numpy().reshape(-1, width)
                part = terms(stats, batch.column("y").to_numpy(), batch.column("fold").to_numpy())
                total = part if total is None else total + part
        yield from packed(total)

    def add(batches):
        total = None
        for batch in batches:
            for one in batch.column("total").to_pylist():
                part = np.frombuffer(one)
                total = part if total is None else total + part
        yield from packed(total)

    made = rows.mapInArrow(run, "total binary").repartition(SUMS).mapInArrow(add, "total binary").collect()
    return sum(np.frombuffer(bytes(r.total)) for r in made) if made else np.zeros(0)


def text_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and stats of every row, stored: texts are read once."""
    fields = [StructField("stats", ArrayType(DoubleType(), False), False)]
    rows = per_document(docs, fields, lambda: lambda batch: [list(statistics(texts_of(batch)))])
    return staged(rows, "quality-stats")


def fit(stats: DataFrame, labels: DataFrame) -> Model | float:
    """Model of P(label 1), or a constant where there is nothing to learn from."""
    known = stats.join(labels.where("quality is not null").select("doc_id", F.col("quality").cast("double").alias("y")), "doc_id")
    known = known.where(~held_out(F.col("doc_id"))).select("stats", "y", _fold(F.col("doc_id")).alias("fold"))
    known = staged(known, "quality-known")
    moments = _partition_sums(known, lambda x, y, _: np.concatenate(([len(y), y.sum()], x.sum(0), (x * x).sum(0))))
    if not len(moments):
        return 0.5
    n, share = moments[0], moments[1] / moments[0]
    if share in (0.0, 1.0):
        return float(share)
    mean, square = np.split(moments[2:] / n, 2)
    deviation = np.sqrt(np.maximum(square - mean * mean, 1e-12))
    base = Model(mean, np.maximum(deviation, 1e-3), np.zeros(FEATURES + 1), np.zeros(2), np.zeros(2))

    def normal(x, y, fold):
        z = np.concatenate((base.features(x), y[:, None]), axis=1)
        return np.stack([z[fold == f].T @ z[fold == f] for f in (0, 1)]).ravel()

    by_fold = _partition_sums(known, normal).reshape(2, FEATURES + 2, FEATURES + 2)
    base.weights = _solve(by_fold.sum(0))
    other = [_solve(by_fold[1 - f]) if by_fold[1 - f][-2, -2] else base.weights for f in (0, 1)]

    def binned(x, y, fold):
        total = np.zeros((2, BINS))
        for f in (0, 1):
            raw = np.clip(base.features(x[fold == f]) @ other[f], -0.5, 1.5)
            at = np.minimum(((raw + 0.5) / 2 * BINS).astype(int), BINS - 1)
            total += np.stack((np.bincount(at, minlength=BINS), np.bincount(at, weights=y[fold == f], minlength=BINS)))
        return total.ravel()

    count, ones = _partition_sums(known, binned).reshape(2, BINS)
    full = np.flatnonzero(count)
    base.edges = (full + 0.5) / BINS * 2 - 0.5
    base.levels = np.clip(isotonic(ones[full] / count[full], count[full]), 0, 1)
    return base


def _scorer(model: Model | float):
    return (lambda x: np.full(len(x), model)) if isinstance(model, float) else model.score


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``."""
    stats = text_statistics(docs)
    sent = docs.sparkSession.sparkContext.broadcast(fit(stats, labels))

    def run(batches):
        score = _scorer(sent.value)
        for batch in batches:
            if batch.num_rows:
                rows = batch.column("stats").flatten().to_numpy().reshape(batch.num_rows, -1)
                made = [batch.column("doc_id"), pa.array(score(rows), pa.float64())]
                yield pa.RecordBatch.from_arrays(made, names=["doc_id", "score"])

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double"
    scored = stats.select("doc_id", "stats").mapInArrow(run, schema)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def good_documents(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """The rows of ``docs`` that score ``cut`` or more, all columns as they are."""
    sent = docs.sparkSession.sparkContext.broadcast(fit(text_statistics(docs), labels))
    return keep_documents(docs, lambda: lambda batch: _scorer(sent.value)(statistics(texts_of(batch))) >= cut)
