"""Periodic runs: stretches of words that repeat with a period, found by descending-LCP Kruskal.

The suffixes of a document are sorted, and neighbours are joined to classes in the order
of their common prefix, longest first. A class keeps its positions in order. Two positions
i < j that become neighbours in a class at prefix length l have exactly l words in common;
if j - i <= l, words from i to j + l repeat with period j - i: a seed. The first two
occurrences of a run's period always become neighbours, so the least i over the seeds of
one (end, period) is the run's start. A period is the smallest one unless a smaller period
has the same end and reaches as far back.

A run of at least ``MIN_LENGTH`` words that holds its period twice has a prefix of
``MIN_LENGTH // 2`` words or more in common with itself one period later. So only suffixes
whose first words of that number occur twice in their document are sorted, and only joins
down to that length are made: prose costs one pass over its words.

Work stays inside a document and runs where its row is read, without a shuffle; short
documents are taken together in slabs. Memory follows the slab, or a single longer text
(10 to 45 times its size while it is worked on, by how much of it repeats).

Words are runs of anything but ASCII white space. Defined cases: a null, empty or blank
text has no words and no runs; its collapsed text is empty. Repeated rows each give a row;
a null doc_id stays null; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .common import WordIds, per_document, sorted_stretches, stretches, texts_of

#: Least words of a run.
MIN_LENGTH = 12

RUN = StructType([StructField(n, LongType(), False) for n in ("start", "length", "period")])


def _repeated_starts(words: WordIds, width: int) -> np.ndarray:
    """Positions whose next ``width`` words may occur again in their document (a hash tells, so some may not)."""
    n = len(words.ids) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    start = np.flatnonzero(words.document[:n] == words.document[width - 1 :])
    code = words.document[:n].astype(np.uint64)
    for j in range(width):
        code = (code ^ (code >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + words.ids[j : n + j].astype(np.uint64)
    code = code[start]
    order = np.argsort(code, kind="stable")
    same = code[order][1:] == code[order][:-1]
    twice = np.concatenate((same, [False])) | np.concatenate(([False], same)) if len(order) else np.zeros(0, dtype=bool)
    return np.sort(start[order[twice]])


def close_prefixes(words: WordIds, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbours of the suffix order with a common prefix of at least ``width`` words in one document.

    Gives two positions and the length of their common prefix. The order comes from
    prefix doubling over the stretches that repeated starts cover; beyond such a stretch
    no prefix of that width can be shared.
    """
    start = _repeated_starts(words, width)
    covered = np.zeros(len(words.ids) + 1, dtype=np.int64)
    np.add.at(covered, start, 1)
    np.add.at(covered, start + width, -1)
    place, end = stretches(np.cumsum(covered[:-1]) > 0, words.document)
    if not len(place):
        return place, place, place
    order, common = sorted_stretches(words.document[place] * (len(words.number) + 1) + words.ids[place], end)
    close = common >= width
    return place[order[:-1][close]], place[order[1:][close]], common[close]


def seeds(a: np.ndarray, b: np.ndarray, common: np.ndarray) -> dict[tuple[int, int], int]:
    """Least start by (end, period), from joining classes by descending common prefix."""
    order = np.argsort(-common, kind="stable")
    parent: dict[int, int] = {}
    members: dict[int, list[int]] = {}
    found: dict[tuple[int, int], int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while (up := parent.get(x, x)) != top:
            parent[x], x = top, up
        return top

    for i, j, length in zip(a[order].tolist(), b[order].tolist(), common[order].tolist(), strict=True):
        large, small = root(i), root(j)
        if large == small:
            continue
        into, new = members.get(large) or [large], members.pop(small, None) or [small]
        if len(into) < len(new):
            members.pop(large, None)
            large, small, into, new = small, large, new, into
        parent[small] = large
        # pairs of the two classes alone: those have exactly this prefix in common
        for x in new:
            at = bisect_left(into, x)
            for left, right in ((into[at - 1], x) if at else (x, x), (x, into[at]) if at < len(into) else (x, x)):
                if 0 < right - left <= length:
                    key = (right + length, right - left)
                    if left < found.get(key, left + 1):
                        found[key] = left
        if len(new) == 1:
            into.insert(at, x)
        else:
            into.extend(new)
            into.sort()  # two sorted stretches, so one merge
        members[large] = into
    return found


def runs_of(words: WordIds, min_length: int = MIN_LENGTH) -> list[tuple[int, int, int]]:
    """(start, end, period) of all runs, as positions in the slab, by start and period."""
    found = seeds(*close_prefixes(words, max(1, min_length // 2)))
    by_end: dict[int, list[tuple[int, int]]] = {}
    for (end, period), start in found.items():
        if end - start >= max(min_length, 2 * period):
            by_end.setdefault(end, []).append((period, start))
    made = []
    for end, some in by_end.items():
        first = end
        for period, start in sorted(some):
            if start < first:  # no smaller period reaches as far back
                first = start
                made.append((start, end, period))
    return sorted(made, key=lambda r: (r[0], r[2]))


def find_runs(docs: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """Runs of every row of ``docs`` and its text with each run cut down to its first period.

    Columns: doc_id, n_words, runs (start word, length, period; by start, then period),
    collapsed (kept words joined by one space). A word is dropped if a run holds it
    after that run's first period.
    """
    if min_length < 2:
        raise ValueError("a run has at least two words")
    fields = [StructField("n_words", LongType(), False), StructField("runs", ArrayType(RUN, False), False), StructField("collapsed", StringType(), False)]

    def score(batch):
        documents = [t.split() for t in texts_of(batch)]
        words = WordIds(documents)
        runs: list[list[tuple[int, int, int]]] = [[] for _ in documents]
        dropped = np.zeros(len(words.ids), dtype=bool)
        for start, end, period in runs_of(words, min_length):
            document = int(words.document[start])
            runs[document].append((start - int(words.starts[document]), end - start, period))
            dropped[start + period : end] = True
        collapsed = []
        for d, own in enumerate(documents):
            if runs[d]:
                own = [own[i] for i in np.flatnonzero(~dropped[words.starts[d] : words.ends[d]]).tolist()]
            collapsed.append(b" ".join(own).decode("utf-8", "replace"))
        return [words.lengths, runs, collapsed]

    return per_document(docs, fields, lambda: score)


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))


def plant_repeats(docs: DataFrame) -> DataFrame:
    """Documents of which about one in ten has its later words overwritten by a repeated stretch.

    With h the CRC-32 of the decimal doc_id and g = h // 10: where h % 10 = 0, word i from
    a = g % n on becomes word a + (i - a) % p, p = 1 + (n - a) // (3 + g % 8). A null
    doc_id and a text without words stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    words, n, g = F.col("_words"), F.size("_words").cast("bigint"), F.floor(F.col("_h") / 10)
    a = F.pmod(g, F.greatest(n, F.lit(1).cast("bigint")))
    p = F.floor((n - F.col("_a")) / (F.lit(3) + F.pmod(g, F.lit(8).cast("bigint")))) + 1

    def source(i: Column) -> Column:
        return F.get(words, F.when(i < F.col("_a"), i).otherwise(F.col("_a") + F.pmod(i - F.col("_a"), F.col("_p"))).cast("int"))

    marked = docs.select("doc_id", "text", h.alias("_h"))
    planted = F.col("_h") % 10 == 0
    cut = marked.withColumn("_words", F.when(planted, words_of(F.col("text"))).otherwise(F.array().cast("array<string>")))
    sized = cut.withColumn("_a", a).withColumn("_p", p)
    repeated = F.array_join(F.transform(F.sequence(F.lit(0).cast("bigint"), n - 1), source), " ")
    return sized.select("doc_id", F.when(n > 0, repeated).otherwise(F.col("text")).alias("text"))
