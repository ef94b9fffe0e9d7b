"""Benchmark decontamination with suffix arrays of the training text.

Each task takes its documents in shards of bounded size and sorts the suffixes
of a shard's words (prefix doubling, as deep as a window). Every suffix of
every benchmark item is searched in it by binary search, all of them at once,
one word deeper at a time, equal windows of the benchmark once; the suffixes that reach
the window length give the places of all verbatim occurrences. Those places and the
windows found there are sorted to their full depth and joined by descending common
prefix, which gives the longest match of each document and item. Work and memory follow
the words and the found (document, item) pairs, not the pairs of windows and occurrences.
Documents are neither shuffled nor joined.

The benchmark is the stated query set. It goes to the tasks in blocks of bounded size, of
whole items. One block needs one pass over the documents; a larger benchmark takes a pass a
block over stored rows, and the passes are put together by row.

Words: A-Z lower-cased, then runs of anything but ASCII non-alphanumerics.
Defined cases: a null text has no words; an item without words is never found; a
null item_id is written as an empty string in lists of items; items that repeat an
item_id count once; a null doc_id stays null; empty tables give no rows or no hits.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from ..session import staged
from .common import WordIds, dense, keep_documents, per_document, slabs, sorted_stretches, stretches, texts_of

WINDOW = 10
#: Bytes of items that go to the tasks at once.
BLOCK_BYTES = 16 << 20
#: Text of a shard: its suffix array and words take about forty times as much memory.
SHARD_BYTES = 4 << 20

_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def suffix_order(ids: np.ndarray, depth: int) -> np.ndarray:
    """Positions in the order of the suffixes that start there, compared over ``depth`` words at least.

    Prefix doubling: the first key packs as many words as fit 62 bits; positions that
    still tie are ordered by the rank of the position that many words on.
    """
    n = len(ids)
    if not n:
        return np.zeros(0, dtype=np.int64)
    bits = int(ids.max()).bit_length() or 1
    width = max(1, min(depth, 62 // bits))
    padded = np.concatenate((ids, np.zeros(width, dtype=np.int64)))
    key = np.zeros(n, dtype=np.int64)
    for j in range(width):
        key = (key << bits) | padded[j : j + n]
    order = np.argsort(key, kind="stable")
    key = key[order]
    head = np.concatenate(([True], key[1:] != key[:-1]))
    while width < depth:
        group = np.maximum.accumulate(np.where(head, np.arange(n), 0))
        rank = np.empty(n + 1, dtype=np.int64)
        rank[order] = group + 1
        rank[n] = 0
        tied = ~head
        tied[:-1] |= ~head[1:]
        at = np.flatnonzero(tied)
        if not len(at):
            break
        places = order[at]
        second = rank[np.minimum(places + width, n)]
        by = group[at] * (n + 2) + second
        again = np.argsort(by, kind="stable")
        order[at] = places[again]
        by = by[again]
        head[at] = np.concatenate(([True], by[1:] != by[:-1]))
        width *= 2
    return order


class Shard:
    """Documents' words as numbers, a zero after each document, and their suffix array."""

    def __init__(self, documents: list[list[bytes]], depth: int):
        made = WordIds(documents)
        self.n_documents, self.number = len(documents), made.number
        self.starts = made.starts + np.arange(self.n_documents)
        self.ids = np.zeros(len(made.ids) + self.n_documents, dtype=np.int64)
        self.ids[np.arange(len(made.ids)) + made.document] = made.ids
        self.document = np.repeat(np.arange(self.n_documents), made.lengths + 1)
        self.order = suffix_order(self.ids, depth)

    def _bound(self, low: np.ndarray, high: np.ndarray, word: np.ndarray, depth: int, after: bool) -> np.ndarray:
        """Binary search, for all queries at once, of the first place (or the one after the last) of the word."""
        low, high = low.copy(), high.copy()
        end = len(self.ids) - 1
        while (inside := low < high).any():
            middle = (low + high) // 2
            at = self.order[np.minimum(middle, end)] + depth
            there = np.where(at <= end, self.ids[np.minimum(at, end)], -1)
            right = inside & ((there <= word) if after else (there < word))
            low = np.where(right, middle + 1, low)
            high = np.where(inside & ~right, middle, high)
        return low

    def search(self, query: np.ndarray, starts: np.ndarray, lengths: np.ndarray):
        """Of each query suffix that matches in all its ``lengths`` words: number, and first and last place in the order."""
        leading = self.ids[self.order]
        word = query[starts]
        low, high = np.searchsorted(leading, word, "left"), np.searchsorted(leading, word, "right")
        number, depth, done = np.arange(len(starts)), 1, []
        while True:
            found = low < high
            full = found & (lengths[number] == depth)
            done.append((number[full], low[full], high[full]))
            on = found & (lengths[number] > depth)
            number, low, high = number[on], low[on], high[on]
            if not len(number):
                return tuple(map(np.concatenate, zip(*done, strict=True)))
            word = query[starts[number] + depth]
            first = self._bound(low, high, word, depth, False)
            low, high = first, self._bound(first, high, word, depth, True)
            depth += 1


class Queries:
    """A block of benchmark items; one query suffix for every different window of their words.

    ``items``: (item_id as text, words before it in its item, words). An item shorter than
    a window is one window itself.
    """

    def __init__(self, items: list[tuple[str, int, list[bytes]]], window: int = WINDOW):
        made = WordIds([words for _, _, words in items])
        self.words, self.ids, self.window, self.document = list(made.number), made.ids, window, made.document
        self.items = sorted({item for item, _, _ in items})
        names = {item: k for k, item in enumerate(self.items)}
        counts = np.where(made.lengths > 0, np.maximum(made.lengths - window, 0) + 1, 0)
        within = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
        # of every window: its place in the words, its length, its item and where it starts there
        self.places = np.repeat(made.starts, counts) + within
        sizes = np.repeat(np.minimum(made.lengths, window), counts)
        self.item = np.repeat(np.array([names[r[0]] for r in items], dtype=np.int64), counts)
        self.item_start = np.repeat(np.array([r[1] for r in items], dtype=np.int64), counts) + within
        self.first = made.starts[made.document[self.places]] == self.places
        # different windows, and which one every window is
        code, base = sizes.copy(), len(self.words) + 2
        for j in range(window):
            word = np.zeros(len(code), dtype=np.int64)
            long = sizes > j
            word[long] = self.ids[self.places[long] + j]
            code = dense(code * base + word)
        _, lead, self.kind = np.unique(code, return_index=True, return_inverse=True)
        self.starts, self.lengths = self.places[lead], sizes[lead]
        # the items of every different window
        pair = np.unique(self.kind * (len(self.items) + 1) + self.item)
        self.kind_item = pair % (len(self.items) + 1)
        self.kind_end = np.cumsum(np.bincount(pair // (len(self.items) + 1), minlength=len(lead)))

    def occurrences(self, shard: Shard) -> tuple[np.ndarray, np.ndarray]:
        """(different window, place in the shard's words) of every verbatim occurrence; of one length, one at most for each place."""
        if not len(self.starts) or not len(shard.ids):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        number, first, last = shard.search(self.numbers(shard)[self.ids - 1], self.starts, self.lengths)
        sizes = last - first
        within = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return np.repeat(number, sizes), shard.order[np.repeat(first, sizes) + within]

    def numbers(self, shard: Shard) -> np.ndarray:
        """The shard's number of each of the words; -2 if it has none."""
        return np.array([shard.number.get(w, -2) for w in self.words], dtype=np.int64)


class Found:
    """What a block finds in a shard, by document.

    Nothing here has a row for each window and occurrence: a place of the shard belongs to
    one different window of a length, and items and documents meet as sets.
    """

    def __init__(self, queries: Queries, documents: list[list[bytes]]):
        self.shard = Shard(documents, queries.window)
        self.n, self.queries = len(documents), queries
        self.kind, self.place = queries.occurrences(self.shard)

    def contaminated(self) -> np.ndarray:
        return np.bincount(self.shard.document[self.place], minlength=self.n) > 0

    def spans(self) -> tuple[np.ndarray, np.ndarray]:
        """Documents and word ranges: windows that overlap or touch make one."""
        edges = np.zeros(len(self.shard.ids) + 1, dtype=np.int64)
        np.add.at(edges, self.place, 1)
        np.add.at(edges, self.place + self.queries.lengths[self.kind], -1)
        hit = np.concatenate(([0], np.cumsum(edges[:-1]) > 0, [0])).astype(np.int8)
        first, last = np.flatnonzero(np.diff(hit) == 1), np.flatnonzero(np.diff(hit) == -1)
        document = self.shard.document[first]
        return document, np.stack((first, last), axis=1) - self.shard.starts[document][:, None]

    def matches(self) -> dict[tuple[int, int], tuple[int, int, int]]:
        """By (document, item): words of the longest match (negative), its place in the shard and its start in the item; the first in the document."""
        best = self._longest()
        short = self.queries.lengths[self.kind] < self.queries.window
        kind, place = self.kind[short], self.place[short]
        order = np.lexsort((place, self.shard.document[place], kind))
        kind, place = kind[order], place[order]
        document = self.shard.document[place]
        head = np.ones(len(kind), dtype=bool)
        head[1:] = (kind[1:] != kind[:-1]) | (document[1:] != document[:-1])
        for k, p, d in zip(kind[head].tolist(), place[head].tolist(), document[head].tolist(), strict=True):
            row = (-int(self.queries.lengths[k]), p, 0)
            for item in self._items(k):
                best[d, item] = min(best.get((d, item), row), row)
        return best

    def _items(self, kind: int) -> list[int]:
        q = self.queries
        return q.kind_item[q.kind_end[kind - 1] if kind else 0 : q.kind_end[kind]].tolist()

    def _longest(self) -> dict[tuple[int, int], tuple[int, int, int]]:
        """Matches of a window and more.

        Suffixes of the hit words of documents and items are sorted together and joined to
        classes by descending common prefix. Where a document and an item first come together
        the prefix is their longest match. If all of a class follow the same word, they came
        together one word earlier, so only other joins look at pairs, and only at new ones.
        """
        q, shard, window = self.queries, self.shard, self.queries.window
        full = q.lengths[self.kind] == window
        places = self.place[full]
        hit = np.zeros(len(q.lengths), dtype=bool)
        hit[self.kind[full]] = True
        own = np.flatnonzero(hit[q.kind])  # windows of items
        if not len(places):
            return {}

        def around(starts: np.ndarray, n: int) -> np.ndarray:
            marks = np.zeros(n + 1, dtype=np.int64)
            np.add.at(marks, starts, 1)
            np.add.at(marks, starts + window, -1)
            return np.cumsum(marks[:-1]) > 0

        there, there_end = stretches(around(places, len(shard.ids)), shard.document)
        here, here_end = stretches(around(q.places[own], len(q.ids)), q.document)
        numbers = q.numbers(shard)
        key = np.concatenate((shard.ids[there], numbers[q.ids[here] - 1]))
        order, common = sorted_stretches(key, np.concatenate((there_end, here_end + len(there))))
        close = common >= window
        a, b, common = order[:-1][close], order[1:][close], common[close]
        # of every position: its document or item, where it is there, and the word before it (0: none)
        window_at = np.full(len(q.ids), -1)
        window_at[q.places] = np.arange(len(q.places))
        at_item = window_at[here]
        owner = np.concatenate((shard.document[there], q.item[at_item]))
        at = np.concatenate((there, q.item_start[at_item]))
        before = np.concatenate((shard.ids[there - 1], np.where(q.first[at_item], 0, numbers[q.ids[here - 1] - 1])))
        before[: len(there)][there == 0] = 0
        return _first_meetings(a, b, common, len(there), owner, at, before)

    def by_document(self) -> tuple[list, list]:
        spans: list[list] = [[] for _ in range(self.n)]
        document, ranges = self.spans()
        for d, (a, b) in zip(document.tolist(), ranges.tolist(), strict=True):
            spans[d].append({"start": a, "end": b})
        matches: list[list] = [[] for _ in range(self.n)]
        for (d, i), (n, p, s) in sorted(self.matches().items()):
            matches[d].append({"item": self.queries.items[i], "item_start": s, "start": p - int(self.shard.starts[d]), "n_words": -n})
        return spans, matches


def _first_meetings(
    a: np.ndarray, b: np.ndarray, common: np.ndarray, n_there: int, owner: np.ndarray, at: np.ndarray, before: np.ndarray
) -> dict[tuple[int, int], tuple[int, int, int]]:
    """By (document, item), the longest prefix (negative) at which suffixes of both are in one class, and their first places.

    Positions below ``n_there`` are of documents, the others of items. A class: its
    documents and its items, each with its first place, and the word that all of it follow
    (0 if they differ).
    """
    parent: dict[int, int] = {}
    classes: dict[int, tuple[dict, dict, int]] = {}
    best: dict[tuple[int, int], tuple[int, int, int]] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while (up := parent.get(x, x)) != top:
            parent[x], x = top, up
        return top

    def single(x: int) -> tuple[dict, dict, int]:
        one = {int(owner[x]): int(at[x])}
        return (one, {}, int(before[x])) if x < n_there else ({}, one, int(before[x]))

    order = np.argsort(-common, kind="stable")
    rows = list(zip(a[order].tolist(), b[order].tolist(), common[order].tolist(), strict=True))
    met: list[tuple[int, int, int]] = []
    for k, (i, j, length) in enumerate(rows):
        x, y = root(i), root(j)
        if x != y:
            large, small = classes.pop(x, None) or single(x), classes.pop(y, None) or single(y)
            if len(large[0]) + len(large[1]) < len(small[0]) + len(small[1]):
                x, y, large, small = y, x, small, large
            parent[y] = x
            docs, items, word = large
            if not word or word != small[2]:
                word = 0
                for d in small[0].keys() - docs.keys():
                    met += [(x, d, t) for t in items if (d, t) not in best]
                for t in small[1].keys() - items.keys():
                    met += [(x, d, t) for d in docs if (d, t) not in best]
            for into, new in ((docs, small[0]), (items, small[1])):
                for name, place in new.items():
                    if place < into.get(name, place + 1):
                        into[name] = place
            classes[x] = (docs, items, word)
        if met and (k + 1 == len(rows) or rows[k + 1][2] != length):
            for x, d, t in met:
                docs, items, _ = classes[root(x)]
                row = (-length, docs[d], items[t])
                best[d, t] = min(best.get((d, t), row), row)
            met = []
    return best


def benchmark_items(benchmark: DataFrame) -> DataFrame:
    """item and words (space-joined) of every item that has words."""

    def run(batches):
        for part in slabs(batches):
            rows = [(item, b" ".join(own)) for item, text in zip(part.column("item").to_pylist(), texts_of(part), strict=True) if (own := words_of(text))]
            item, words = zip(*rows, strict=True) if rows else ((), ())
            yield pa.RecordBatch.from_pydict({"item": pa.array(item, pa.string()), "words": pa.array(words, pa.binary())})

    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text")
    return rows.mapInArrow(run, "item string, words binary")


class Blocks:
    """The benchmark's items in stored form, read in blocks of about ``block_bytes``, or of one longer item.

    The driver holds one block of the stated query set at a time, never a large one whole.
    """

    def __init__(self, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES):
        self.window, self.stored = window, staged(benchmark_items(benchmark), "benchmark-items")
        total = self.stored.agg(F.sum(F.length("words"))).first()[0] or 0
        self.n = 1 if total <= block_bytes else -(-2 * total // block_bytes)

    def sent(self, k: int):
        """Block ``k``, ready for the tasks."""
        part = self.stored.where(F.pmod(F.xxhash64("item"), F.lit(self.n)) == k)
        rows = sorted((r.item, bytes(r.words)) for r in part.collect())
        return part.sparkSession.sparkContext.broadcast(Queries([(item, 0, words.split()) for item, words in rows], self.window))


_MATCH = StructType(
    [StructField("item", StringType()), StructField("item_start", LongType()), StructField("start", LongType()), StructField("n_words", LongType())]
)
_SPAN = StructType([StructField("start", LongType()), StructField("end", LongType())])
_FOUND = [
    StructField("n_words", LongType(), False),
    StructField("spans", ArrayType(_SPAN), False),
    StructField("matches", ArrayType(_MATCH), False),
]


def _pass(docs: DataFrame, sent) -> DataFrame:
    def start():
        def score(batch):
            documents = [words_of(t) for t in texts_of(batch)]
            return [list(map(len, documents)), *Found(sent.value, documents).by_document()]

        return score

    return per_document(docs, _FOUND, start, SHARD_BYTES)


def find_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """What the benchmark has in common with every row of ``docs``.

    Columns: doc_id, n_words, spans (hit word ranges in order, end exclusive, apart
    from each other) and matches (by item found: its longest verbatim match, and where
    it starts in the item and in the document).
    """
    blocks = Blocks(benchmark, window, block_bytes)
    if blocks.n == 1:
        return _pass(docs, blocks.sent(0))
    numbered = docs.select(F.struct("doc_id", F.monotonically_increasing_id().alias("row")).alias("doc_id"), "text")
    rows = staged(numbered, "benchmark-rows")
    passes = [staged(_pass(rows, blocks.sent(k)), "benchmark-pass") for k in range(blocks.n)]
    whole = reduce(DataFrame.unionByName, passes).groupBy("doc_id").agg(
        F.first("n_words").alias("n_words"),
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.flatten(F.collect_list("matches")).alias("matches"),
    )
    matches = F.array_sort("matches")  # an item is in one block
    return whole.select("doc_id.doc_id", "n_words", _joined("spans").alias("spans"), matches.alias("matches"))


def _joined(spans: str) -> Column:
    """Sorted ranges, those that overlap or touch put together."""
    last = lambda acc: F.element_at(acc, F.lit(-1))
    return F.aggregate(
        F.col(spans),
        F.slice(F.col(spans), 1, 1),
        lambda acc, x: F.when(x["start"] > last(acc)["end"], F.concat(acc, F.array(x))).otherwise(
            F.concat(
                F.slice(acc, F.lit(1), F.size(acc) - 1),
                F.array(F.struct(last(acc)["start"].alias("start"), F.greatest(last(acc)["end"], x["end"]).alias("end"))),
            )
        ),
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` without any window of the benchmark, all columns as they are."""
    blocks = Blocks(benchmark, window, block_bytes)
    for k in range(blocks.n):
        docs = _clean(docs, blocks.sent(k))
    return docs


def _clean(docs: DataFrame, sent) -> DataFrame:
    def start():
        return lambda batch: ~Found(sent.value, [words_of(t) for t in texts_of(batch)]).contaminated()

    return keep_documents(docs, start, SHARD_BYTES)
