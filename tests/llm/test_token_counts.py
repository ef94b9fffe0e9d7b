import base64
import random

import public_tokenizers

from tokentide.llm import token_counts as tc

random.seed(11)


def plain(pieces, word):
    """Cut greedily, building the pieces."""
    n = 0
    while word:
        size = next((k for k in range(len(word), 0, -1) if word[:k] in pieces), 0)
        if not size:
            return -1
        word, n = word[size:], n + 1
    return n


def test_automaton_equals_greedy_cutting():
    for _ in range(2000):
        pieces = {bytes(random.choices(b"abc", k=random.randrange(1, 6))) for _ in range(random.randrange(0, 12))}
        automaton = tc.Automaton(pieces)
        for _ in range(8):
            word = bytes(random.choices(b"abc", k=random.randrange(0, 14)))
            assert automaton.count(word) == plain(pieces, word)


def test_public_vocabulary():
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    pieces = set(tc.read_pieces(path))
    automaton = tc.Automaton(pieces)
    for word in ["hello", "naïve", "unbelievably", "x" * 500, "漢字", "####", "a" * 3]:
        assert automaton.count(b" " + word.encode()) == plain(pieces, b" " + word.encode())


def test_unknown_words(spark, make_docs, tmp_path):
    path = tmp_path / "ranks"
    path.write_bytes(b"\n".join(base64.b64encode(p) + b" %d" % i for i, p in enumerate([b" a", b"b", b"ab"])))
    got = tc.token_counts(make_docs([(1, "a ab abb aab x ba")]), str(path)).first()
    # " a", " a"+"b", " a"+"b"+"b", " a"+"ab"; "x" and "ba" have no cover
    assert tuple(got) == (1, 17, 6, 1 + 2 + 3 + 2 + 2, 2)


def test_odd_rows_and_empty_table(odd_docs, odd_rows, no_docs):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    pieces = set(tc.read_pieces(path))
    got = tc.token_counts(odd_docs, path).collect()
    want = [(str(d), len((t or "").encode().split()), sum(plain(pieces, b" " + w) for w in (t or "").encode().split() if len(w) < 1000)) for d, t in odd_rows if d != 8]
    assert sorted((str(r.doc_id), r.n_words, r.n_tokens) for r in got if r.doc_id != 8) == sorted(want)
    assert all(r.n_unknown == 0 for r in got)
    assert tc.token_counts(no_docs, path).count() == 0
