"""Spelling variants: words at one edit from a far more frequent word.

Words are counted over all documents; the vocabulary is then searched for pairs at one
edit (one character inserted, deleted or replaced) by dynamic programming over sorted
lists: a query scans the sorted words, keeps the banded rows of its edit matrix for the
characters that a word shares with the one before it, and leaves out every range of words
whose shared prefix is already beyond one edit. Rows have three entries, the band of one
edit, and many queries scan side by side in numpy.

No task sees the whole vocabulary. Of two words at one edit, the shorter with m
characters, one holds: the first half of m characters agrees, or the last half does. So
each word goes into the groups of its beginning and of its end, for m its own length and
one less; a pair belongs to the first kind if its common prefix reaches there and else to
the second, hence to exactly one group. Groups of ends are scanned from the back. A group
above ``GROUP_WORDS`` words or ``GROUP_BYTES`` is split in the same way by the part that is
still open, until all are small or one character is open (then the alphabet bounds them).

A word's form is its near word with the largest count (at equal counts the first in
code-point order), if that count is at least twice the word's own. Counts at least double
along forms, so chains are short; roots are found by doubling the steps, in rounds whose
number is the logarithm of the longest chain.

Words are maximal runs of ``[A-Za-z\\u00C0-\\u00FF]``, with A-Z alone lower-cased. Defined
cases: a null text has no words; a row with a null doc_id counts like any other (for
``Typos`` its id is empty); repeated rows count each; words of any length are held
whole; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import staged
from .common import slabs, texts_of

#: Least code points and occurrences of a word.
MIN_CHARS = 5
MIN_COUNT = 3
#: A form has at least this many times the word's count.
RATIO = 2
#: Bounds of a group; larger ones are split.
GROUP_WORDS = 20_000
GROUP_BYTES = 16 << 20
#: Words that a task holds before it hands on their counts, and their bytes.
HELD_WORDS = 300_000
HELD_BYTES = 32 << 20
#: Of every so many (document, word) pairs one loses a character in ``Typos``.
TYPO_EVERY = 97

_RUN = re.compile("[a-zÀ-ÿ]+")
#: Code points of words lie below this one, so a byte holds one.
_SINGLE_BYTE = "latin-1"


class Typos:
    """Which words of a document lose a character: those for which ``TYPO_EVERY`` divides the CRC-32 of ``doc_id:word``.

    CRCs are linear: that of both parts is that of the first, moved on by the length of
    the second, xor that of the second; so each document and each word is hashed once.
    """

    _longest = 64

    def __init__(self):
        table = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
        self.table = table.astype(np.uint32)

    def moved(self, prefixes: list[bytes]) -> np.ndarray:
        """By prefix and number of bytes that follow."""
        state = np.fromiter(map(zlib.crc32, prefixes), dtype=np.uint32, count=len(prefixes))
        made = [state]
        for _ in range(self._longest):
            state = self.table[state & 255] ^ (state >> np.uint32(8))
            made.append(state)
        return np.stack(made, axis=1)

    def hashes(self, prefixes: list[bytes], document: np.ndarray, words: list[str], ids: np.ndarray, crc: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Of each occurrence: its document, its word's number, and by number CRC and bytes."""
        short = size[ids] <= self._longest
        hashed = self.moved(prefixes)[document, np.where(short, size[ids], 0)] ^ crc[ids]
        for at in np.flatnonzero(~short).tolist():
            hashed[at] = zlib.crc32(words[ids[at]].encode(), zlib.crc32(prefixes[document[at]]))
        return hashed


class _Counts:
    """Counts of words held by a task, with each word's CRC and size."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.words: list[str] = []
        self.crc, self.size, self.count = (np.zeros(0, dtype=t) for t in (np.uint32, np.int64, np.int64))
        self.held = 0

    def ids(self, words: list[str]) -> np.ndarray:
        number = self.number
        made = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=len(words))
        new = list(number)[len(self.words) :] if len(number) > len(self.words) else []
        raw = [w.encode() for w in new]
        self.words += new
        self.crc = np.concatenate((self.crc, np.fromiter(map(zlib.crc32, raw), dtype=np.uint32, count=len(raw))))
        self.size = np.concatenate((self.size, np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))))
        self.count = np.concatenate((self.count, np.zeros(len(raw), dtype=np.int64)))
        self.held += sum(map(len, raw))
        return made


def word_counts(docs: DataFrame, typos: bool = False) -> DataFrame:
    """(word, n) over all texts. With ``typos`` some words lose a character first, see ``Typos``.

    A task adds up what it reads and hands on a row per word; Spark sums those before and
    after the shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rule, held = Typos(), _Counts()
        for part in slabs(batches):
            found = [_RUN.findall(t.lower().decode("utf-8", "replace")) for t in texts_of(part)]
            ids = held.ids([w for words in found for w in words])
            if typos and len(ids):
                document = np.repeat(np.arange(len(found)), list(map(len, found)))
                prefixes = [b"%s:" % (b"" if d is None else str(d).encode()) for d in part.column("doc_id").to_pylist()]
                h = rule.hashes(prefixes, document, held.words, ids, held.crc, held.size)
                hit = np.flatnonzero(h % TYPO_EVERY == 0)
                cut = [(w := held.words[ids[at]])[: (k := int(h[at]) % len(w))] + w[k + 1 :] for at in hit.tolist()]
                ids[hit] = held.ids(cut)
            held.count += np.bincount(ids, minlength=len(held.words))
            if len(held.words) > HELD_WORDS or held.held > HELD_BYTES:
                yield from _counted(held)
                held = _Counts()
        yield from _counted(held)

    rows = docs.select("doc_id", "text").mapInArrow(run, "word string, n bigint")
    return rows.groupBy("word").agg(F.sum("n").alias("n"))


def _counted(held: _Counts) -> Iterator[pa.RecordBatch]:
    some = np.flatnonzero(held.count)
    for at in range(0, len(some), 1 << 15):
        own = some[at : at + (1 << 15)]
        yield pa.RecordBatch.from_pydict({"word": [held.words[i] for i in own.tolist()], "n": held.count[own]})


def vocabulary(counts: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT) -> DataFrame:
    return counts.where((F.length("word") >= min_chars) & (F.col("n") >= min_count))


# --- groups ---------------------------------------------------------------------------

#: A group: the length m of the shorter word of its pairs, how many first and last characters
#: its words share, and the length that a pair's common prefix stays below.
GROUP = ["m", "a", "b", "below"]


def _whole(words: DataFrame, min_chars: int) -> DataFrame:
    """Each word in the groups of its own length and of one less."""
    size = F.length("word")
    m = F.explode(F.when(size > min_chars, F.array(size, size - 1)).otherwise(F.array(size)))
    return words.select("word", "n", m.alias("m")).select(
        "word", "n", "m", F.lit(0).alias("a"), F.lit(0).alias("b"), (F.col("m") + 2).alias("below")
    )


def _halved(rows: DataFrame) -> DataFrame:
    """Each row in the two groups that its group splits into."""
    t = F.floor((F.col("m") - F.col("a") - F.col("b")) / 2).cast("int")
    front = F.struct((F.col("a") + t).alias("a"), F.col("b").alias("b"), F.col("below").alias("below"))
    back = F.struct(F.col("a").alias("a"), (F.col("b") + t).alias("b"), F.least(F.col("below"), F.col("a") + t).alias("below"))
    return rows.select("word", "n", "m", F.explode(F.array(front, back)).alias("g")).select("word", "n", "m", "g.*")


def _key() -> list[Column]:
    word = F.col("word")
    shared = (F.left(word, F.col("a")).alias("_left"), F.right(word, F.col("b")).alias("_right"))
    return [*map(F.col, GROUP), *shared]


def _grouped(words: DataFrame, min_chars: int, group_words: int, group_bytes: int) -> DataFrame:
    rows = _halved(_whole(words, min_chars))
    while True:
        n = F.count("*")
        sizes = rows.groupBy(*_key()).agg(n.alias("_size")).where(F.col("m") - F.col("a") - F.col("b") >= 2)
        large = staged(sizes.where((F.col("_size") > group_words) | (F.col("_size") * F.col("m") > group_bytes)).drop("_size"), "spelling-large")
        if large.isEmpty():
            return rows
        keyed, on = rows.select("*", *_key()[len(GROUP) :]), [*GROUP, "_left", "_right"]
        rows = keyed.join(large, on, "left_anti").select(*rows.columns).unionByName(_halved(keyed.join(large, on, "left_semi").select(*rows.columns)))


# --- the scan ---------------------------------------------------------------------------


def shared_prefixes(matrix: np.ndarray, size: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Of each row and the one before it; -1 where a group starts, and one more at the end."""
    n = len(size)
    common = np.full(n + 1, -1, dtype=np.int64)
    if n > 1:
        both = np.minimum(size[1:], size[:-1])
        differ = matrix[1:] != matrix[:-1]
        first = np.where(differ.any(axis=1), differ.argmax(axis=1), matrix.shape[1])
        common[1:n] = np.minimum(first, both)
    common[starts] = -1
    return common


def _next_smaller(values: np.ndarray) -> np.ndarray:
    made, stack = np.zeros(len(values), dtype=np.int64), []
    for i, v in enumerate(values.tolist()):
        while stack and stack[-1][1] > v:
            made[stack.pop()[0]] = i
        stack.append((i, v))
    return made


def scan(words: list[bytes], starts: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, word) at exactly one edit within groups of sorted distinct words.

    ``starts``: where groups begin; ``first``: by group, how many first characters all of
    its words share. A lane for each query: the word it is at, how many characters of it
    are done, and the rows of the edit matrix up to there.
    """
    n, none = len(words), np.zeros(0, dtype=np.int64)
    if not n:
        return none, none
    size = np.fromiter(map(len, words), dtype=np.int64, count=n)
    width = int(size.max())
    matrix = np.array(words, dtype=f"S{width}").view(np.uint8).reshape(n, width)
    common = shared_prefixes(matrix, size, starts)
    after = _next_smaller(common)
    # as queries: a blank before, two behind; blanks match no character
    query = np.zeros((n, width + 3), dtype=np.uint8)
    query[:, 1 : width + 1] = matrix
    ended = np.zeros((n, width + 1), dtype=np.uint8)
    ended[:, :width] = matrix
    group = np.cumsum(np.bincount(starts, minlength=n)[:n]) - 1

    lane = np.arange(n)  # of the query
    at, done = starts[group], first[group]
    rows = np.zeros((n, width + 2, 3), dtype=np.int8)
    rows[lane, done] = np.where(done[:, None] > 0, np.array([1, 0, 1], dtype=np.int8), np.array([2, 0, 1], dtype=np.int8))
    hits: list[tuple[np.ndarray, np.ndarray]] = []
    while len(lane):
        c = ended[at, done]
        row = rows[lane, done]
        whole = done == size[at]
        if whole.any():
            i, j = lane[whole], at[whole]
            place = size[i] - size[j] + 1
            near = (place >= 0) & (place <= 2)
            near[near] = row[whole][near, place[near]] == 1
            if near.any():
                hits.append((i[near], j[near]))
        x0 = np.minimum(row[:, 1] + 1, row[:, 0] + (query[lane, done] != c))
        x1 = np.minimum(np.minimum(row[:, 2] + 1, row[:, 1] + (query[lane, done + 1] != c)), x0 + 1)
        x2 = np.minimum(row[:, 2] + (query[lane, done + 2] != c), x1 + 1)
        on = ~whole & (np.minimum(np.minimum(x0, x1), x2) <= 1)
        into = lane[on]
        rows[into, done[on] + 1] = np.minimum(np.stack((x0[on], x1[on], x2[on]), axis=1), 2)
        done = done + on
        # the others leave out all words that share what has been read
        rest = np.flatnonzero(~on)
        if len(rest):
            to, limit = at[rest] + 1, done[rest]
            while (over := common[to] > limit).any():
                to[over] = after[to[over]]
            at[rest], done[rest] = to, common[to]
            open_ = done >= 0
            if not open_.all():
                lane, at, done = lane[open_], at[open_], done[open_]
    if not hits:
        return none, none
    return np.concatenate([h[0] for h in hits]), np.concatenate([h[1] for h in hits])


#: Rows and characters that are scanned side by side; a larger group is taken alone.
SCAN_ROWS = 50_000
SCAN_CELLS = 8 << 20


def _near_words(rows: list[tuple[int, int, int, int, str, int]]) -> pa.RecordBatch:
    """Near words in whole groups: by word, how many and the best one."""
    m, a, b, below = (np.array([r[k] for r in rows], dtype=np.int64) for k in range(4))
    words, count = [r[4] for r in rows], np.array([r[5] for r in rows], dtype=np.int64)
    keys = [(*r[:4], r[4][: r[1]], r[4][len(r[4]) - r[2] :]) for r in rows]
    starts = np.array([i for i, k in enumerate(keys) if not i or k != keys[i - 1]], dtype=np.int64)
    plain = [w.encode(_SINGLE_BYTE) for w in words]
    turned = [w[::-1] if back else w for w, back in zip(plain, (b > a).tolist(), strict=True)]
    i, j = scan(turned, starts, np.maximum(a, b)[starts])
    size = np.fromiter(map(len, plain), dtype=np.int64, count=len(plain))
    own = np.minimum(size[i], size[j]) == m[i]
    i, j = i[own], j[own]
    differ = np.fromiter((p[:k] != q[:k] for p, q, k in zip((plain[x] for x in i.tolist()), (plain[x] for x in j.tolist()), below[i].tolist(), strict=True)), dtype=bool, count=len(i))
    i, j = i[differ], j[differ]
    order = np.lexsort((np.array(plain)[j], -count[j], i))
    i, j = i[order], j[order]
    of, at, many = np.unique(i, return_index=True, return_counts=True)
    return pa.RecordBatch.from_pydict(
        {
            "word": pa.array([words[x] for x in of.tolist()], pa.string()),
            "n_near": pa.array(many, pa.int64()),
            "form": pa.array([words[x] for x in j[at].tolist()], pa.string()),
            "form_n": pa.array(count[j[at]], pa.int64()),
        }
    )


def near_words(words: DataFrame, min_chars: int = MIN_CHARS, group_words: int = GROUP_WORDS, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """Of each word (word, n) with near words: n_near, and the best near word with its count."""
    rows = _grouped(words, min_chars, group_words, group_bytes).select(*GROUP, "word", "n")
    turned = F.when(F.col("b") > F.col("a"), F.reverse("word")).otherwise(F.col("word"))
    dealt = rows.repartition(*_key()).sortWithinPartitions(*_key(), turned)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        last, cells = None, 0
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                key = (*r[:4], r[4][: r[1]], r[4][len(r[4]) - r[2] :])
                if key != last and (len(held) > SCAN_ROWS or cells > SCAN_CELLS):
                    yield _near_words(held)
                    held, cells = [], 0
                last = key
                held.append(r)
                cells = max(cells, len(held) * len(r[4]))
        if held:
            yield _near_words(held)

    found = dealt.mapInArrow(run, "word string, n_near bigint, form string, form_n bigint")
    best = F.min(F.struct((-F.col("form_n")).alias("less"), F.col("form").alias("form"))).alias("best")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select(
        "word", "n_near", F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n")
    )


# --- forms and roots ---------------------------------------------------------------------


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of each word that has a form, by doubling the steps in rounds."""
    steps = staged(forms.where("form is not null").select("word", F.col("form").alias("root")), "spelling-steps")
    while True:
        on = steps.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        far = staged(steps.join(on, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "spelling-steps")
        if far.where("_moved").isEmpty():
            return steps
        steps = far.select("word", "root")


def variants(words: DataFrame, ratio: int = RATIO, **bounds) -> DataFrame:
    """Every word (word, n) with its near words, form and root.

    Columns: word, n, n_near, form, form_n, root. A word without a form is its own root.
    ``min_chars`` (of ``bounds``) is the least length in ``words``.
    """
    own = staged(words.select("word", "n"), "spelling-words")
    found = own.join(near_words(own, **bounds), "word", "left")
    is_form = F.col("form_n") >= ratio * F.col("n")
    forms = staged(
        found.select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
            F.when(is_form, F.col("form")).alias("form"),
            F.when(is_form, F.col("form_n")).alias("form_n"),
        ),
        "spelling-forms",
    )
    return forms.join(roots(forms), "word", "left").withColumn("root", F.coalesce("root", "word"))


def spelling_variants(docs: DataFrame, typos: bool = False, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, ratio: int = RATIO) -> DataFrame:
    """Words of all texts of ``docs`` with their forms and roots, see ``variants``."""
    return variants(vocabulary(word_counts(docs, typos), min_chars, min_count), ratio, min_chars=min_chars)
