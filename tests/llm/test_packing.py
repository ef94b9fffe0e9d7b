import random
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tokentide.llm import packing as p

PATH = public_tokenizers.path("byte_bpe_50k.json")
random.seed(13)


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def test_encoder_equals_the_tokenizer(tokenizer):
    encoder = p.Encoder(PATH)
    bits = ["a", "B", "word", " ", "  ", "\n", "\t", "é", "漢", "　", "\xa0", "1", "'s", "'", "!", "<|endoftext|>", "\x1c", "\x85", "\r\n"]
    texts = ["".join(random.choices(bits, k=random.randrange(0, 25))) for _ in range(3000)]
    for at in range(0, len(texts), 100):
        if at % 700 == 0:
            encoder.cache.clear()
        for text, ids in zip(texts[at : at + 100], encoder.ids(texts[at : at + 100]), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("cached", [0, 20, p.CACHED])
def test_encoder_with_marks_lines_and_generations(tokenizer, cached):
    """Marks after letters and after others, line ends, long chunks, and a cache that turns over all the time."""
    encoder, own = p.Encoder(PATH, cached), random.Random(17)
    words = ["the", "Über", "straße", "naïve", "x" * 300, "don't", "a.b", "ж", "漢字", "3", "ß"]
    ends = ["", ".", ",", "...", ")", "),", "'", "\x01", "_", "_,", "!", "\n", ".\n", ",\n", "\n\n", " ", "\t"]
    texts = ["".join(own.choice(words) + own.choice(ends) + own.choice([" ", " ", "\n", ""]) for _ in range(own.randrange(0, 14))) for _ in range(2500)]
    texts += ["", " ", "\n", ".", ", a", ". a", "\x01", "\x01. a", "a. ", "a.\n", "\n.", "a .\nb", "a\n. b", "<|endoftext|>, a", "a, <|endoftext|>"]
    for at in range(0, len(texts), 50):
        for text, ids in zip(texts[at : at + 50], encoder.ids(texts[at : at + 50]), strict=True):
            assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_the_cache_is_bounded_by_bytes():
    encoder = p.Encoder(PATH, 2_000)
    for n in range(30):
        encoder.ids([" ".join(f"{n}-{i}-" + "q" * 2000 for i in range(100))])
        assert sum(map(len, encoder.cache)) < 64 * 2_000 + 100 * 2_010 and len(encoder.flat) < 10**6


def test_level_leaves_the_least_sum_of_squares():
    for _ in range(300):
        packer = p.Packer(window=16)
        packer.count[1:16] = [random.choice([0, 0, 1, 2, 5]) for _ in range(15)]
        size = random.randrange(1, 16)

        def after(level, packer=packer, size=size):
            count = packer.count.copy()
            if level:
                count[level] -= 1
            count[level + size] += 1
            return (count[1:16] ** 2).sum()

        open_ = [0] + [g for g in range(1, 17 - size) if packer.count[g]]
        best = min(after(g) for g in open_)
        assert packer.level(size) == max(g for g in open_ if after(g) == best)


@pytest.mark.parametrize("max_open", [3, p.MAX_OPEN])
def test_windows_are_gapless_and_full(max_open):
    packer, made, sent = p.Packer(window=64, max_open=max_open), [], {}
    for row in range(400):
        sent[row] = np.arange(random.randrange(1, 64)) + row
        made += packer.place(row, 0, sent[row])
        assert packer.n_open < max_open
    made += packer.flush()
    fill, back = defaultdict(int), defaultdict(list)
    for row, start, ids, window, offset in made:
        assert fill[window] == offset
        fill[window] += len(ids)
        back[row].append((start, ids))
    assert all(np.array_equal(np.concatenate([i for _, i in sorted(back[r], key=lambda x: x[0])]), sent[r]) for r in sent)
    assert set(fill) == set(range(len(fill)))
    assert all(n <= 64 and n & (n - 1) == 0 for n in fill.values())


def check(pieces, docs, tokenizer):
    """Every id lies in one piece, sequences have no gap and need little padding."""
    whole, fill = defaultdict(dict), defaultdict(list)
    for r in pieces:
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length > 0
        whole[r.doc_id, r.doc_tokens].setdefault(r.start, []).append(ids.tolist())
        fill[r.sequence_id].append((r.offset, r.length))
    want = defaultdict(lambda: defaultdict(list))
    for doc_id, text in docs:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        want[doc_id, len(ids)][tuple(ids)].append(1)
    got = defaultdict(int)
    for (doc_id, n), by_start in whole.items():
        assert sum(len(i) for parts in by_start.values() for i in parts) == n * sum(map(len, want[doc_id, n].values()))
        if all(len(v) == 1 for v in by_start.values()):
            assert sum((by_start[s][0] for s in sorted(by_start)), []) in [list(t) for t in want[doc_id, n]]
        got[doc_id] += 1
    assert set(got) == {d for d, _ in docs}
    for parts in fill.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024 and at & (at - 1) == 0


def test_pack(make_docs, tokenizer):
    docs = [(i, " ".join(random.choices(["some", "words", "of", "text\n", "naïve"], k=random.randrange(0, 3000)))) for i in range(60)]
    check(p.pack(make_docs(docs).repartition(3), PATH).collect(), docs, tokenizer)


def test_odd_rows_and_empty_table(odd_docs, odd_rows, no_docs, tokenizer):
    check(p.pack(odd_docs, PATH).collect(), odd_rows, tokenizer)
    assert p.pack(no_docs, PATH).count() == 0
    with pytest.raises(ValueError):
        p.pack(no_docs, PATH, window=1000)
