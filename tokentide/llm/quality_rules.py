"""Quality rules: a few counts, and a log-likelihood ratio of hashed n-grams.

The ratio compares two multinomials over hashed n-grams (runs of four bytes, which
rare words share): one of a trusted target (documents labelled as good) and one of
the raw corpus (every document). A document's score is the mean log ratio of its n-grams, so length
does not matter, and it is kept if the score reaches a fixed threshold; no
document is drawn at random.

Raw counts cover all documents, the target every document labelled as good. Ids of good
documents grow with the table, so they meet the texts in a hash join by doc_id, which moves
each text once and sorts none. The model has a fixed number of buckets.

Words are runs of anything but ASCII white space. Defined cases: a null or empty
text has no words, score 0 and fails the base rules; without any trusted text the
score is 0 and the base rules alone decide; a null doc_id is never trusted;
repeated rows count each; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField

from . import textstats
from .common import WordIds, keep_documents, least_hashed, per_document, slabs, texts_of

#: Bytes of an n-gram and bits of its hash.
NGRAM = 4
BUCKET_BITS = 16
BUCKETS = 1 << BUCKET_BITS
#: Ids that ``trusted_ids`` lists, at most; the target is fitted on all of them.
TRUSTED_DOCS = 50_000
#: Pseudo-counts of the target, spread over buckets as the raw corpus is.
PRIOR = 2 * BUCKETS
#: Least mean log ratio of a document that is kept.
THRESHOLD = -0.25
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50

_MIX = np.uint32(0x9E3779B1)

def hashed_ngrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and document of every run of ``NGRAM`` bytes."""
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    buffer = np.frombuffer(b"".join(texts), dtype=np.uint8)
    document = np.repeat(np.arange(len(texts), dtype=np.int32), lengths)
    n = max(0, len(buffer) - NGRAM + 1)
    code = np.zeros(n, dtype=np.uint32)
    for j in range(NGRAM):
        code = (code << np.uint32(8)) | buffer[j : j + n]
    inside = document[:n] == document[NGRAM - 1 :] if n else np.zeros(0, dtype=bool)
    bucket = (code[inside] * _MIX) >> np.uint32(32 - BUCKET_BITS)
    return bucket.astype(np.int32), document[:n][inside]


def trusted(labels: DataFrame) -> DataFrame:
    """Ids of all documents labelled good, each once."""
    return labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct()


def trusted_ids(labels: DataFrame, limit: int = TRUSTED_DOCS) -> list:
    """A list of ``limit`` documents labelled good, with the least hashed ids, to look at; no model is fitted on it."""
    return [r[0] for r in least_hashed(trusted(labels), limit).collect()]


def fit(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """Log ratio by bucket: target over raw corpus."""

    def run(batches):
        counts = np.zeros((2, BUCKETS), dtype=np.int64)
        for part in slabs(batches):
            good = part.column("good").to_numpy(zero_copy_only=False)
            bucket, document = hashed_ngrams(texts_of(part))
            counts[0] += np.bincount(bucket[good[document]], minlength=BUCKETS)
            counts[1] += np.bincount(bucket, minlength=BUCKETS)
        full = np.flatnonzero(counts[1])
        yield pa.RecordBatch.from_pydict({"bucket": full, "target": counts[0][full], "raw": counts[1][full]})

    good_ids = trusted(labels).withColumn("good", F.lit(True)).hint("shuffle_hash")
    marked = docs.select("doc_id", "text").join(good_ids, "doc_id", "left")
    counted = marked.select("text", F.coalesce("good", F.lit(False)).alias("good")).mapInArrow(run, "bucket bigint, target bigint, raw bigint")
    rows = counted.groupBy("bucket").agg(F.sum("target"), F.sum("raw")).toPandas().to_numpy()
    target, raw = np.zeros(BUCKETS), np.zeros(BUCKETS)
    if len(rows):
        target[rows[:, 0]], raw[rows[:, 0]] = rows[:, 1], rows[:, 2]
    return log_ratio(target, raw)


def log_ratio(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Smoothed towards the raw corpus, so that a bucket without evidence says nothing."""
    if not target.sum():
        return np.zeros(len(raw))
    share = (raw + 0.5) / (raw + 0.5).sum()
    return np.log((target + PRIOR * share) / (target.sum() + PRIOR)) - np.log(share)


def mean_ratio(ratio: np.ndarray, texts: list[bytes]) -> np.ndarray:
    bucket, document = hashed_ngrams(texts)
    n = np.bincount(document, minlength=len(texts))
    return np.bincount(document, weights=ratio[bucket], minlength=len(texts)) / np.maximum(n, 1)


def _verdicts(texts: list[bytes], ratio: np.ndarray, threshold: float):
    words = WordIds([t.split() for t in texts])
    repeated = textstats.repeated_words(words)
    score = mean_ratio(ratio, texts)
    failed = (words.lengths < MIN_WORDS) | (100 * repeated > MAX_REPEATED_PERCENT * words.lengths)
    return words, repeated, score, failed, ~failed & (score >= threshold)


def judge(docs: DataFrame, ratio: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """Counts, score and verdict of every row of ``docs``.

    Columns: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, score.
    """
    fields = [StructField(n, LongType(), False) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    fields += [StructField("base_failed", BooleanType(), False), StructField("kept", BooleanType(), False), StructField("score", DoubleType(), False)]
    sent = docs.sparkSession.sparkContext.broadcast(ratio)

    def start():
        def score(batch):
            texts = texts_of(batch)
            words, repeated, scores, failed, kept = _verdicts(texts, sent.value, threshold)
            lines = [textstats.duplicate_lines(t)[1] for t in texts]
            return [words.lengths, list(map(textstats.word_chars, texts)), list(map(textstats.symbols, texts)), lines, repeated, failed, kept, scores]

        return score

    return per_document(docs, fields, start)


def kept_documents(docs: DataFrame, ratio: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the rules keep, all columns as they are."""
    sent = docs.sparkSession.sparkContext.broadcast(ratio)
    return keep_documents(docs, lambda: lambda batch: _verdicts(texts_of(batch), sent.value, threshold)[-1])
