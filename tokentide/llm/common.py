"""Reading the tables and running numpy code over Arrow batches of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

#: Bytes of text that one call of a scorer gets (one longer text comes alone).
SLAB_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slabs(batches: Iterator[pa.RecordBatch], limit: int = SLAB_BYTES, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into row ranges whose text stays below ``limit`` bytes."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        upto, start = np.cumsum(sizes, dtype=np.int64), 0
        while start < batch.num_rows:
            before = int(upto[start - 1]) if start else 0
            end = max(start + 1, int(np.searchsorted(upto, before + limit, side="right")))
            yield batch.slice(start, end - start)
            start = end


def texts_of(batch: pa.RecordBatch) -> list[bytes]:
    """The texts as UTF-8 bytes; null counts as empty."""
    return [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]


def per_document(docs: DataFrame, fields: list[StructField], start: Callable[[], Callable], limit: int = SLAB_BYTES) -> DataFrame:
    """One row per document: its doc_id and ``fields``.

    ``start()`` runs once a task and returns a scorer: Arrow batch -> lists or
    arrays in the order of ``fields``. Only doc_id and text are read, so further
    columns of any name do no harm; no shuffle.
    """
    schema = StructType([docs.schema["doc_id"], *fields])
    arrow = to_arrow_schema(schema)

    def run(batches):
        score = start()
        for part in slabs(batches, limit):
            made = [pa.array(v, type=f.type) for v, f in zip(score(part), list(arrow)[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *made], schema=arrow)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def keep_documents(docs: DataFrame, start: Callable[[], Callable], limit: int = SLAB_BYTES) -> DataFrame:
    """The rows of ``docs`` that the task's scorer marks true, all columns as they are."""

    def run(batches):
        score = start()
        for part in slabs(batches, limit):
            yield part.filter(pa.array(score(part), type=pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def least_hashed(rows: DataFrame, limit: int) -> DataFrame:
    """The ``limit`` rows with the least hashed doc_id, the same ones whatever the partitions.

    A bound on the hash comes first, so that all tasks together hand on about twice
    as many rows, not ``limit`` each.
    """
    place, n = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)), rows.count()
    if n > 2 * limit:
        rows = rows.where(place < int((1 << 40) * 2 * limit / n))
    return rows.orderBy(place, "doc_id").limit(limit)


class WordIds:
    """Numbers for words, held for one slab at a time.

    Word ids start at 1; 0 stands between documents.
    """

    def __init__(self, documents: list[list[bytes]]):
        self.number: dict[bytes, int] = {}
        seen = self.number
        self.lengths = np.fromiter(map(len, documents), dtype=np.int64, count=len(documents))
        self.ends = np.cumsum(self.lengths)
        self.starts = self.ends - self.lengths
        n = int(self.ends[-1]) if documents else 0
        flat = (seen.setdefault(w, len(seen) + 1) for words in documents for w in words)
        self.ids = np.fromiter(flat, dtype=np.int64, count=n)
        self.document = np.repeat(np.arange(len(documents)), self.lengths)


def dense(key: np.ndarray) -> np.ndarray:
    """Numbers from 0 for the values, in their order."""
    return np.unique(key, return_inverse=True)[1].astype(np.int64)


def sorted_stretches(key: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes of stretches, by prefix doubling, and the common prefix of each but the first with the one before.

    ``key``: by position, a number for what stands there; ``end``: where its stretch ends.
    A suffix reaches to the end of its stretch.
    """
    m = len(key)
    at, ranks = np.arange(m), [dense(key)]
    longest = int((end - at).max(initial=0))
    while 1 << (len(ranks) - 1) < longest and int(ranks[-1].max()) < m - 1:
        half = 1 << (len(ranks) - 1)
        second = np.zeros(m, dtype=np.int64)
        inside = at + half < end
        second[inside] = ranks[-1][at[inside] + half] + 1
        ranks.append(dense(ranks[-1] * (m + 1) + second))
    order = np.argsort(ranks[-1], kind="stable")
    a, b = order[:-1], order[1:]
    common = np.zeros(len(b), dtype=np.int64)
    for k in reversed(range(len(ranks))):
        i, j = a + common, b + common
        fits = (i + (1 << k) <= end[a]) & (j + (1 << k) <= end[b])
        fits[fits] = ranks[k][i[fits]] == ranks[k][j[fits]]
        common[fits] += 1 << k
    return order, common


def stretches(covered: np.ndarray, document: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marked positions, and for each the index after its stretch: of neighbours in one document."""
    place = np.flatnonzero(covered)
    cut = np.flatnonzero((np.diff(place) != 1) | (np.diff(document[place]) != 0)) + 1
    bounds = np.concatenate((cut, [len(place)]))
    return place, np.repeat(bounds, np.diff(np.concatenate(([0], bounds))))
