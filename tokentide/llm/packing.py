"""Packing documents into token windows by the sum-of-squares rule.

Each task packs the documents it reads, in their order, without a shuffle. A
document is its token ids and an end id. Whole windows are cut from its front;
what is left goes, online, to the fill level that leaves the least sum of squared
counts of partly filled windows, looked up in an array of windows by level (a new
window counts as level zero; at equal sums the fullest wins). Windows that are
still open at the end of the task, or when a task holds ``max_open`` of them, are
closed by cutting: their pieces in order fill windows one after the other, and
the last part is cut at powers of two, which need no padding.

Ids come from the public tokenizer file named by ``path``. They are looked up by
chunk: a chunk starts at a single space or line end between two characters that are not
white space, where this tokenizer always starts a new piece, so chunks are encoded
alone with the same result, once for as long as they stay in a bounded cache.

Defined cases: a null or empty text is its end id alone; a null doc_id stays null;
repeated rows are packed each; an empty table gives no pieces.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import compress, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from .common import slabs, texts_of

WINDOW = 1024
END_ID = 0
MAX_OPEN = 1024
#: Chunks of a generation whose ids a worker keeps; each 64 characters of a chunk count as one more.
CACHED = 600_000
#: Put before a mark that is a chunk by itself.
MARK = "\x01"


def _gather(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The stretches of ``flat`` one after the other."""
    upto = np.cumsum(size)
    return flat[np.repeat(start - upto + size, size) + np.arange(int(size.sum()))]


class Encoder:
    """Token ids of whole texts, as little-endian unsigned 32-bit numbers.

    ``cache`` numbers the chunks that are known; of each number, ``start`` and ``size`` tell
    its ids in ``flat``. When ``cached`` are known they become the older generation, of which
    those come back that are met again; so frequent chunks stay.
    """

    _cut = re.compile(r"(?<=\S) (?=\S)|(?<=\S)(?=\n\S)")
    _other_white = re.compile(r"[^\S \n]")
    # a mark alone after a letter, before white space
    _mark = re.compile(r"([.,])(?<=[A-Za-zÀ-ÖØ-öø-ÿ][.,])(?=[ \n])")
    _letters = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
    _of: dict[str, Encoder] = {}

    def __init__(self, path: str, cached: int = CACHED):
        from tokenizers import Tokenizer, pre_tokenizers

        self.cached = cached
        self.tokenizer = Tokenizer.from_file(path)
        # of letters alone each word is one piece: in the vocabulary's own letters for bytes, cut at the one for a space
        letters = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.byte_letters = {b: letters.pre_tokenize_str(chr(b))[0][0] for b in range(128)}
        for b, c in ((b, letters.pre_tokenize_str(bytes((0xC2 + (b >> 6 & 1), b & 0xBF)).decode())[0][0]) for b in range(128, 192)):
            self.byte_letters[b] = c[1]
        self.byte_letters[0xC3] = letters.pre_tokenize_str("é")[0][0][0]
        self.word_tokenizer = Tokenizer.from_file(path)
        self.word_tokenizer.pre_tokenizer = pre_tokenizers.Split(self.byte_letters[32], "merged_with_next")
        words = self.tokenizer.get_vocab(with_added_tokens=True)
        # of a byte-level vocabulary: a character of a piece stands for a byte of the text
        self.n_bytes = np.zeros(max(words.values()) + 1, dtype=np.int64)
        for piece, i in words.items():
            self.n_bytes[i] = len(piece)
        self.line_end = self._encode("\n")
        self._begin()
        self.older: tuple[dict, np.ndarray, np.ndarray, np.ndarray] = ({}, self.start, self.size, self.flat)

    def _begin(self) -> None:
        self.cache: dict[str, int] = {}
        self.start, self.size, self.flat, self.weight = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype="<u4"), 0
        for mark in ".,":
            ids = self._encode(mark)
            self._add([MARK + mark], np.array([len(ids)]), ids)

    @classmethod
    def of(cls, path: str, cached: int = CACHED) -> Encoder:
        """One encoder for a worker, whichever task asks."""
        if path not in cls._of:
            cls._of[path] = cls(path)
        cls._of[path].cached = cached
        return cls._of[path]

    def _encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

    def _chunks(self, text: str) -> list[str]:
        """The text, cut at single spaces, which go, and before single line ends.

        In a text without other white space or ``MARK`` also before a full stop or comma after a letter.
        """
        if MARK in text or "  " in text or "\n\n" in text or " \n" in text or "\n " in text or self._other_white.search(text):
            return self._cut.split(text)
        chunks = self._mark.sub(f" {MARK}\\1", text).replace("\n", " \n").split(" ")
        # an empty or blank chunk at an end was white space there
        return self._cut.split(text) if len(chunks) > 1 and not (chunks[0] and chunks[-1].strip()) else chunks

    def _add(self, chunks: list[str], size: np.ndarray, ids: np.ndarray) -> None:
        n = len(self.start)
        self.cache.update(zip(chunks, range(n, n + len(chunks)), strict=True))
        self.start = np.concatenate((self.start, len(self.flat) + np.cumsum(size) - size))
        self.size = np.concatenate((self.size, size))
        self.flat = np.concatenate((self.flat, ids))
        self.weight += len(chunks) + sum(map(len, chunks)) // 64

    def _learn(self, new: list[str]) -> None:
        """Take chunks from the older generation, or encode them.

        They neither end in white space nor begin with more than a line end, so they are
        encoded as one text, whose ids are cut at the chunks' ends.
        """
        cache, start, size, flat = self.older
        if cache and (back := [c for c in new if c in cache]):
            number = np.fromiter(map(cache.__getitem__, back), dtype=np.int64, count=len(back))
            self._add(back, size[number], _gather(flat, start[number], size[number]))
            new = [c for c in new if c not in cache]
        is_word = [(c.isalpha() if c.isascii() else bool(self._letters.fullmatch(c))) for c in new]
        words, rest = list(compress(new, is_word)), [c for c, own in zip(new, is_word, strict=True) if not own]
        for at in range(0, len(words), 1 << 15):
            some = words[at : at + (1 << 15)]
            text = (" " + " ".join(some)).encode().decode("latin-1").translate(self.byte_letters)
            self._cut_ids(some, np.array(self.word_tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4"))
        for at in range(0, len(rest), 1 << 15):
            some = rest[at : at + (1 << 15)]
            self._cut_ids(some, self._encode("".join([c if c[0] == "\n" else " " + c for c in some])))

    def _cut_ids(self, chunks: list[str], ids: np.ndarray) -> None:
        n_bytes = np.fromiter((len(c.encode()) + (c[0] != "\n") for c in chunks), dtype=np.int64, count=len(chunks))
        upto = np.searchsorted(np.cumsum(self.n_bytes[ids]), np.cumsum(n_bytes)) + 1
        self._add(chunks, np.diff(upto, prepend=0), ids)

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        if self.weight > self.cached:
            self.older = (self.cache, self.start, self.size, self.flat)
            self._begin()
        cut = [self._chunks(t) for t in texts]
        # A text's first chunk has no space before it: it is looked up with a line end, whose id
        # goes again. What begins or ends in white space at an end of the text is encoded alone.
        heads: dict[int, np.ndarray] = {}
        tails: dict[int, np.ndarray] = {}
        for d, chunks in enumerate(cut):
            first, last = chunks[0], chunks[-1]
            if len(chunks) > 1 and last[-1].isspace():
                tails[d] = self._encode(last if last[0] == "\n" else " " + last)
                chunks.pop()
            if not first or first[0].isspace() or len(chunks) == 1 and first[-1].isspace():
                heads[d] = self._encode(first)
                chunks[0] = "\n"
            else:
                chunks[0] = "\n" + first
        flat = [c for chunks in cut for c in chunks]
        number = np.fromiter(map(self.cache.get, flat, repeat(-1)), dtype=np.int64, count=len(flat))
        if (unknown := np.flatnonzero(number < 0)).size:
            some = list(map(flat.__getitem__, unknown.tolist()))
            self._learn(list(dict.fromkeys(some)))
            number[unknown] = np.fromiter(map(self.cache.__getitem__, some), dtype=np.int64, count=len(some))
        size = self.size[number]
        upto = np.cumsum(size)
        ids = _gather(self.flat, self.start[number], size)
        ends = upto[np.cumsum(np.fromiter(map(len, cut), dtype=np.int64, count=len(cut))) - 1] if cut else upto
        made, begin = [], 0
        for d, end in enumerate(ends.tolist()):
            own = ids[begin + len(self.line_end) : end]
            if d in heads or d in tails:
                own = np.concatenate((heads.get(d, own[:0]), own, tails.get(d, own[:0])))
            made.append(own)
            begin = end
        return made


class Packer:
    """Places pieces (row, start, ids) into windows; gives each piece back with its window and offset."""

    def __init__(self, window: int = WINDOW, max_open: int = MAX_OPEN):
        self.window, self.max_open = window, max_open
        self.count = np.zeros(window + 1, dtype=np.int64)
        self.at_level: list[list[list]] = [[] for _ in range(window)]
        self.n_open = 0
        self.next_id = 0

    def _new_id(self) -> int:
        self.next_id += 1
        return self.next_id - 1

    def level(self, size: int) -> int:
        """The fill level whose choice leaves the least sum of squares; zero for a new window."""
        count, room = self.count, self.window - size
        gain = 2 * count[size : size + room + 1] + 1
        gain[room] = 0  # the window is full then
        change = gain.copy()
        change[1:] += 1 - 2 * count[1 : room + 1]
        change[1:][count[1 : room + 1] == 0] = np.iinfo(np.int64).max
        return room - int(np.argmin(change[::-1]))

    def place(self, row, start: int, ids: np.ndarray) -> Iterator[tuple]:
        """``ids``: fewer than a window. Yields the pieces of a window that has become full."""
        size = len(ids)
        level = self.level(size)
        if level:
            pieces = self.at_level[level].pop()
            self.count[level] -= 1
            self.n_open -= 1
        else:
            pieces = []
        pieces.append((row, start, ids))
        level += size
        if level == self.window:
            yield from self._closed([pieces])
        else:
            self.at_level[level].append(pieces)
            self.count[level] += 1
            self.n_open += 1
            if self.n_open >= self.max_open:
                yield from self.flush()

    def whole(self, row, start: int, ids: np.ndarray) -> Iterator[tuple]:
        yield from self._closed([[(row, start, ids)]])

    def _closed(self, windows) -> Iterator[tuple]:
        for pieces in windows:
            name, offset = self._new_id(), 0
            for row, start, ids in pieces:
                yield row, start, ids, name, offset
                offset += len(ids)

    def flush(self) -> Iterator[tuple]:
        """Close all open windows by cutting their pieces."""
        pieces = [p for windows in self.at_level for window in windows for p in window]
        self.count[:] = 0
        self.at_level = [[] for _ in range(self.window)]
        self.n_open = 0
        total = sum(len(ids) for _, _, ids in pieces)
        sizes = [self.window] * (total // self.window)
        sizes += [1 << b for b in reversed(range(self.window.bit_length())) if (total % self.window) >> b & 1]
        made, room = [], 0
        for row, start, ids in pieces:
            while len(ids):
                if not room:
                    room = sizes.pop(0)
                    made.append([])
                cut = min(room, len(ids))
                made[-1].append((row, start, ids[:cut]))
                ids, start, room = ids[cut:], start + cut, room - cut
        yield from self._closed(made)


def pack(
    docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID, max_open: int = MAX_OPEN, cached: int = CACHED
) -> DataFrame:
    """Pieces of all rows of ``docs``.

    Columns: doc_id, start (ids of the document before the piece), length, ids (as
    little-endian unsigned 32-bit numbers), doc_tokens, sequence_id, offset (of the
    piece in its sequence). sequence_id holds the task's number in its upper half. A
    worker keeps the ids of twice ``cached`` chunks (some 200 bytes each) from task to task.
    """
    if window & (window - 1):
        raise ValueError("the window has to be a power of two")
    schema = StructType(
        [docs.schema["doc_id"]]
        + [StructField("start", LongType(), False), StructField("length", LongType(), False), StructField("ids", BinaryType(), False)]
        + [StructField(n, LongType(), False) for n in ("doc_tokens", "sequence_id", "offset")]
    )
    arrow = to_arrow_schema(schema)

    def batch(rows, base: int) -> pa.RecordBatch:
        (docs_, totals), starts, ids, names, offsets = zip(*(r[0] for r in rows), strict=True), *(list(x) for x in list(zip(*rows, strict=True))[1:])
        columns = [docs_, starts, [len(i) for i in ids], [i.tobytes() for i in ids], totals, [base + n for n in names], offsets]
        return pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    def run(batches):
        encoder, packer = Encoder.of(path, cached), Packer(window, max_open)
        base = TaskContext.get().partitionId() << 33
        end = np.array([end_id], dtype="<u4")
        for part in slabs(batches):
            made = []
            encoded = encoder.ids([t.decode("utf-8", "replace") for t in texts_of(part)])
            for doc_id, own in zip(part.column("doc_id").to_pylist(), encoded, strict=True):
                ids = np.concatenate((own, end))
                row, whole = (doc_id, len(ids)), len(ids) - len(ids) % window
                for at in range(0, whole, window):
                    made.extend(packer.whole(row, at, ids[at : at + window]))
                if whole < len(ids):
                    made.extend(packer.place(row, whole, ids[whole:].copy()))
            if made:
                yield batch(made, base)
        if made := list(packer.flush()):
            yield batch(made, base)

    return docs.select("doc_id", "text").mapInArrow(run, schema)
