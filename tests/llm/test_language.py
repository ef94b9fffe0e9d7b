import zlib

import numpy as np
from pyspark.sql import functions as F

from tokentide.llm import language as la
from tokentide.llm.common import table


def test_backpropagation_equals_differences():
    net = la.Network(*(p.astype(np.float64) for p in la.Network.fresh(3, 4).parts()))
    bytes_, size, owner = la.windows([b"abcde", b"xy", b"abcab", b"q"], 5)
    label = np.array([0, 1, 2, 1])
    _, gradients = net.gradients(bytes_, size, label[owner])
    for part, gradient in zip(net.parts(), gradients, strict=True):
        flat, own = part.ravel(), gradient.ravel()
        for i in np.argsort(-np.abs(own))[:4]:
            was, step = flat[i], 1e-2
            flat[i] = was + step
            up = net.gradients(bytes_, size, label)[0]
            flat[i] = was - step
            down = net.gradients(bytes_, size, label)[0]
            flat[i] = was
            assert abs((up - down) / (2 * step) - own[i]) < 1e-3


def plain_positions(net, raw):
    """Probabilities by position with one byte after the other."""
    hidden = net.inner.shape[1]
    logistic = lambda x: 1 / (1 + np.exp(-x))
    made = []
    for d, order in ((0, raw), (1, raw[::-1])):
        h, states = np.zeros(hidden), []
        for b in order:
            x, u = net.table[d, b], h @ net.inner[d]
            z, r = logistic(x[:hidden] + u[:hidden]), logistic(x[hidden : 2 * hidden] + u[hidden : 2 * hidden])
            h = (1 - z) * np.tanh(x[2 * hidden :] + r * u[2 * hidden :]) + z * h
            states.append(h)
        made.append(np.array(states if d == 0 else states[::-1]))
    e = np.exp(np.concatenate(made, axis=1) @ net.out + net.bias)
    return e / e.sum(axis=1, keepdims=True)


def test_whole_texts_are_labelled():
    net = la.Network.fresh(3, 4)
    texts = [b"short", b"", bytes(range(32, 127)) * 4, "é漢".encode() * 40, b"x" * la.WINDOW]
    got = net.document_probabilities(texts)
    for text, row in zip(texts, got, strict=True):
        parts = [plain_positions(net, text[i : i + la.WINDOW]) for i in range(0, len(text), la.WINDOW)]
        want = np.concatenate(parts).mean(axis=0) if parts else np.zeros(3)
        assert np.allclose(row, want, atol=1e-4)


def test_letters():
    assert la.has_letter(b"1 a") and la.has_letter("…漢".encode()) and not la.has_letter("12 … !".encode()) and not la.has_letter(b"")


def test_held_out_rows(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    got = la.identify(docs, la.fit(docs)).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out]
    assert len(got) == docs.count() and len(held) > 150
    assert sum(r.lang_pred == r.lang for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


def test_sample_leaves_held_out_rows_alone(make_docs):
    rows = [(i, f"text number {i} " * 20, "en" if i % 2 else "de") for i in range(60)]
    drawn = {r.text for r in la.sample(make_docs(rows)).collect()}
    for i, text, _ in rows:
        if zlib.crc32(str(i).encode()) % 4 == 2:
            assert not any(f"number {i} " in t for t in drawn)


def test_odd_rows_and_empty_tables(odd_docs, odd_rows, no_docs, make_docs):
    letters = {str(d) for d, t in odd_rows if t and any(c.isalpha() for c in t)}
    nothing = la.identify(odd_docs, la.fit(odd_docs)).collect()  # no row has a language
    assert len(nothing) == len(odd_rows) and {(r.lang_pred, r.score) for r in nothing} == {("und", 0.0)}
    one = la.fit(make_docs([(d, t, "en") for d, t in odd_rows]))
    got = la.identify(odd_docs, one).collect()
    assert {str(r.doc_id) for r in got if r.lang_pred == "en"} == letters
    two = la.fit(make_docs([(i, "aaa bbb" if i % 2 else "ccc ddd", "en" if i % 2 else "de") for i in range(40)]))
    got = la.identify(odd_docs, two).collect()
    assert {str(r.doc_id) for r in got if r.lang_pred != "und"} == letters
    assert la.identify(no_docs, two).count() == 0 and la.fit(no_docs) == ([], None)
