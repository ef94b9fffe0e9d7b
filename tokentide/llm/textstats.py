"""Counts over whole texts, for a slab of documents at a time."""

from __future__ import annotations

import numpy as np

from .common import WordIds

SYMBOLS = b"#*$%&|<>"
_WHITE = b" \t\n\x0b\x0c\r"


def code_points(text: bytes) -> int:
    """Characters of UTF-8: the bytes that don't continue one."""
    return int(np.count_nonzero((np.frombuffer(text, dtype=np.uint8) & 0xC0) != 0x80))


def word_chars(text: bytes) -> int:
    return code_points(text.translate(None, _WHITE))


def symbols(text: bytes) -> int:
    return len(text) - len(text.translate(None, SYMBOLS))


def duplicate_lines(text: bytes) -> tuple[int, int]:
    """Lines with a word, and those of them that equal an earlier one."""
    lines = [line for line in text.split(b"\n") if line.strip()]
    return len(lines), len(lines) - len(set(lines))


def ngram_codes(words: WordIds, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and exact code of every n-word window that stays in its document."""
    base = len(words.number) + 1
    code, size = words.ids.copy(), base
    for j in range(1, n):
        if size * base >= 1 << 62:
            _, code = np.unique(code, return_inverse=True)
            size = int(code.max(initial=0)) + 1
        shifted = np.zeros_like(words.ids)
        shifted[: max(0, len(words.ids) - j)] = words.ids[j:]
        code, size = code * base + shifted, size * base
    inside = np.arange(len(words.ids)) + n <= words.ends[words.document] if len(words.ids) else np.zeros(0, dtype=bool)
    start = np.flatnonzero(inside)
    return start, code[start]


def repeated_words(words: WordIds, n: int = 3) -> np.ndarray:
    """By document, words inside n-word windows that the document holds twice or more."""
    start, code = ngram_codes(words, n)
    order = np.argsort(code, kind="stable")  # positions stay in order, so a document's windows stay together
    code, document = code[order], words.document[start[order]]
    same = (code[1:] == code[:-1]) & (document[1:] == document[:-1])
    twice = np.concatenate((same, [False])) | np.concatenate(([False], same)) if len(order) else np.zeros(0, dtype=bool)
    covered = np.zeros(len(words.ids), dtype=bool)
    for j in range(n):
        covered[start[order][twice] + j] = True
    return np.bincount(words.document, weights=covered, minlength=len(words.lengths)).astype(np.int64)


def distinct_words(words: WordIds) -> tuple[np.ndarray, np.ndarray]:
    """By document, its distinct words and the count of its most frequent one."""
    n = len(words.lengths)
    key, count = np.unique(words.document * (len(words.number) + 1) + words.ids, return_counts=True)
    document = key // (len(words.number) + 1)
    most = np.zeros(n, dtype=np.int64)
    np.maximum.at(most, document, count)
    return np.bincount(document, minlength=n), most
