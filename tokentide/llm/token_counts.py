"""Token counts by a linear longest-match automaton.

A word is cut greedily into the longest pieces of a vocabulary. The automaton is
the vocabulary's trie with, for each node, the number of pieces that are certain
once no edge goes on from it (popped) and the node that stands for what is left
(the failure link). Each byte is looked at once, whatever the piece lengths, and
no piece is ever built: only counts are added.

Pieces are bytes. A word is a run of anything but ASCII white space, looked up
with ``lead`` before it, as word-initial pieces of public byte vocabularies begin
with a space. A word with a byte that no piece covers is one unknown token.

Defined cases: a null text or one without words has no tokens; a null doc_id
stays null; repeated rows count each; an empty table gives no rows.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StructField

from .common import per_document, texts_of

LEAD = b" "
#: Words whose counts a worker keeps.
CACHED = 1_000_000
ROOT, LOST = 0, -1


class Automaton:
    """Trie of ``pieces`` with failure links and popped counts."""

    def __init__(self, pieces: Iterable[bytes]):
        self.step: dict[int, int] = {}  # node and byte -> node
        ends: set[int] = set()
        parent, byte = [ROOT], [0]
        depth = [0]
        for piece in pieces:
            node = ROOT
            for c in piece:
                on = self.step.get(node << 8 | c)
                if on is None:
                    on = self.step[node << 8 | c] = len(parent)
                    parent.append(node)
                    byte.append(c)
                    depth.append(depth[node] + 1)
                node = on
            if node:
                ends.add(node)
        self.fail = [LOST] * len(parent)
        self.popped = [0] * len(parent)
        for node in sorted(range(1, len(parent)), key=depth.__getitem__):
            if node in ends:
                self.fail[node], self.popped[node] = ROOT, 1
                continue
            at, n = self.fail[parent[node]], self.popped[parent[node]]
            while at != LOST and (at << 8 | byte[node]) not in self.step:
                n += self.popped[at]
                at = self.fail[at]
            if at != LOST:
                self.fail[node], self.popped[node] = self.step[at << 8 | byte[node]], n

    def count(self, word: bytes) -> int:
        """Number of greedy longest pieces of the word; -1 if it can't be covered."""
        step, fail, popped = self.step, self.fail, self.popped
        node = n = 0
        for c in word:
            while (on := step.get(node << 8 | c)) is None:
                n += popped[node]
                node = fail[node]
                if node == LOST:
                    return -1
            node = on
        while node > ROOT:
            n += popped[node]
            node = fail[node]
        return n if node == ROOT else -1


def read_pieces(path: str) -> list[bytes]:
    """The pieces of a rank file: a base64 piece and its number on each line."""
    with open(path, "rb") as lines:
        return [base64.b64decode(line.split()[0]) for line in lines if line.strip()]


class _Counts(dict):
    """Word -> number of pieces, for as long as the bounded cache holds it."""

    _of: dict[tuple[str, bytes], _Counts] = {}

    def __init__(self, path: str, lead: bytes):
        self.automaton, self.lead = Automaton(read_pieces(path)), lead

    def __missing__(self, word: bytes) -> int:
        n = self.automaton.count(self.lead + word)
        if len(word) <= 64:
            self[word] = n
        return n

    @classmethod
    def of(cls, path: str, lead: bytes) -> _Counts:
        if (path, lead) not in cls._of:
            cls._of[path, lead] = cls(path, lead)
        return cls._of[path, lead]


def token_counts(docs: DataFrame, path: str, lead: bytes = LEAD) -> DataFrame:
    """doc_id, n_bytes, n_words, n_tokens and n_unknown (words that are one unknown token) of every row."""
    fields = [StructField(n, LongType(), False) for n in ("n_bytes", "n_words", "n_tokens", "n_unknown")]

    def start():
        counts = _Counts.of(path, lead)

        def score(batch):
            rows = []
            for text in texts_of(batch):
                if len(counts) > CACHED:
                    counts.clear()
                words = text.split()
                each = list(map(counts.__getitem__, words))
                unknown = each.count(-1)
                rows.append((len(text), len(words), sum(each) + 2 * unknown, unknown))
            return list(zip(*rows, strict=True))

        return score

    return per_document(docs, fields, start)
