"""Quality rules and quality classifier."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tokentide.llm import quality_classifier as qc
from tokentide.llm import quality_rules as qr
from tokentide.llm import textstats
from tokentide.llm.common import WordIds, table

from .conftest import SF

random.seed(19)


def plain_base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    inside = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    same = sum(x in lines[:i] for i, x in enumerate(lines))
    failed = len(words) < 50 or 100 * len(inside) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), same, len(inside), failed


def plain_ratio(docs, good):
    """Log ratio by bucket, counted with a dict."""
    counts = [Counter(), Counter()]
    for doc_id, text in docs:
        raw = (text or "").encode()
        for i in range(len(raw) - qr.NGRAM + 1):
            bucket = (int.from_bytes(raw[i : i + qr.NGRAM], "big") * 0x9E3779B1 & 0xFFFFFFFF) >> 16
            counts[1][bucket] += 1
            counts[0][bucket] += doc_id in good
    n, m = sum(counts[0].values()), sum(counts[1].values())
    share = lambda b: (counts[1][b] + 0.5) / (m + 0.5 * qr.BUCKETS)
    return {b: np.log((counts[0][b] + qr.PRIOR * share(b)) / (n + qr.PRIOR) / share(b)) for b in counts[1]}


def test_base_counts(make_docs):
    texts = [
        " ".join(random.choices(["a", "b", "c#", "É", "|", "\n", "\n\n", "a b\n", "\x0b", "\x1c", "　"], k=random.randrange(0, 160))) for _ in range(150)
    ]
    got = qr.judge(make_docs(list(enumerate(texts))), np.zeros(qr.BUCKETS)).collect()
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain_base(texts[r.doc_id])
        assert r.kept != r.base_failed


def test_codes_stay_exact_with_many_words():
    words = WordIds([[b"%d" % i for i in range(50)] * 2, [b"%d" % i for i in range(3)]])
    words.number = range(1 << 40)  # as many different words as force a second numbering
    assert textstats.repeated_words(words, 3).tolist() == [100, 0]


def test_ratio_and_verdict_equal_plain(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    good = {r.doc_id for r in labels.where("quality = 1").collect()}
    want = plain_ratio(rows, good)
    ratio = qr.fit(docs, labels)
    assert all(abs(ratio[b] - v) < 1e-9 for b, v in want.items())
    for r in qr.judge(docs, ratio).where(F.col("doc_id") < 40).collect():
        raw = dict(rows)[r.doc_id].encode()
        buckets = [(int.from_bytes(raw[i : i + 4], "big") * 0x9E3779B1 & 0xFFFFFFFF) >> 16 for i in range(len(raw) - 3)]
        score = sum(want[b] for b in buckets) / max(1, len(buckets))
        assert abs(r.score - score) < 1e-9 and r.kept == (not r.base_failed and score >= qr.THRESHOLD)


def test_target_is_fitted_on_every_good_document(spark, make_docs):
    n = 60_000
    docs = make_docs([(i, f"{i % 7}good" if i % 9 else "other") for i in range(n)] + [(None, "good")] * 3)
    labels = spark.range(n).selectExpr("id as doc_id", "int(id % 9 > 0) as quality")
    again = labels.where("doc_id < 50").unionByName(spark.sql("select cast(null as bigint) as doc_id, 1 as quality"))
    want = plain_ratio([(r.doc_id, r.text) for r in docs.collect()], {i for i in range(n) if i % 9})
    ratio = qr.fit(docs, labels.unionByName(again))
    assert all(abs(ratio[b] - v) < 1e-9 for b, v in want.items())


def test_rules_tell_good_from_bad(spark):
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    judged = qr.judge(docs, qr.fit(docs, labels)).join(labels, "doc_id").where(~F.col("base_failed"))
    assert judged.where((F.col("quality") == 1) & ~F.col("kept")).count() == 0
    assert judged.where((F.col("quality") == 0) & F.col("kept")).count() == 0


def test_trusted_sample_is_bounded_and_stable(labels_of):
    labels = labels_of([(i, 1, 0) for i in range(100)] + [(5, 1, 1), (None, 1, 0), (200, 0, 0)])
    assert qr.trusted_ids(labels, 10) == qr.trusted_ids(labels.repartition(7), 10)
    assert len(qr.trusted_ids(labels, 10)) == 10 and len(qr.trusted_ids(labels)) == 100


def test_rules_on_odd_rows_and_empty_tables(odd_docs, odd_rows, no_docs, labels_of):
    for labels in (labels_of([(5, 1, 0), (None, 1, 0), (9, None, None)]), labels_of([])):
        ratio = qr.fit(odd_docs, labels)
        got = qr.judge(odd_docs, ratio).collect()
        assert sorted((str(r.doc_id), r.n_words, r.word_chars) for r in got) == sorted((str(d), *plain_base(t or "")[:2]) for d, t in odd_rows)
        kept = qr.kept_documents(odd_docs, ratio)
        assert kept.schema == odd_docs.schema and kept.count() == sum(r.kept for r in got)
    assert qr.judge(no_docs, qr.fit(no_docs, labels_of([]))).count() == 0
    assert qr.kept_documents(no_docs, np.zeros(qr.BUCKETS)).count() == 0


def test_isotonic_is_the_least_squares_fit():
    for _ in range(200):
        n = random.randrange(1, 8)
        v, c = np.array([random.random() for _ in range(n)]), np.array([random.randrange(1, 5) for _ in range(n)])
        fit = qc.isotonic(v, c)
        # min-max formula of isotonic regression
        mean = lambda a, b, v=v, c=c: (v[a : b + 1] * c[a : b + 1]).sum() / c[a : b + 1].sum()
        assert np.allclose(fit, [max(min(mean(a, b) for b in range(i, n)) for a in range(i + 1)) for i in range(n)])


def test_features_approximate_the_gaussian_kernel(monkeypatch):
    monkeypatch.setattr(qc, "FEATURES", 20_000)
    x = np.random.default_rng(1).standard_normal((6, 16))
    z = qc.Model(np.zeros(16), np.ones(16), np.zeros(1), np.zeros(1), np.zeros(1)).features(x)[:, :-1]
    want = np.exp(-((x[:, None] - x[None]) ** 2).sum(-1) / (2 * qc.WIDTH**2))
    assert np.abs(z @ z.T - want).max() < 0.03


def test_ridge_equals_a_plain_solution(spark, labels_of):
    random_ = np.random.default_rng(2)
    rows = [(i, random_.standard_normal(3).tolist()) for i in range(300)]
    stats = spark.createDataFrame(rows, "doc_id bigint, stats array<double>").repartition(5)
    labels = labels_of([(i, int(s[0] > 0), 0) for i, s in rows])
    model = qc.fit(stats, labels)
    used = {r.doc_id for r in stats.where(~qc.held_out(F.col("doc_id"))).collect()}
    x = np.array([s for i, s in rows if i in used])
    y = np.array([float(s[0] > 0) for i, s in rows if i in used])
    assert np.allclose(model.mean, x.mean(0)) and np.allclose(model.deviation, x.std(0))
    z = model.features(x)
    shrink = qc.RIDGE * len(x) * np.eye(z.shape[1])
    shrink[-1, -1] = 0
    assert np.allclose(z @ np.linalg.solve(z.T @ z + shrink, z.T @ y), z @ model.weights, atol=1e-5)
    assert (np.diff(model.levels) >= 0).all()


def test_classifier_on_held_out_rows(spark):
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    got = qc.classify(docs, labels)
    assert got.count() == docs.count() and got.where("score < 0 or score > 1 or predicted != int(score >= 0.5)").count() == 0
    held = got.where("held_out").join(labels, "doc_id")
    assert held.count() > 80 and held.where("predicted = quality").count() >= 0.97 * held.count()


@pytest.mark.parametrize(("rows", "score"), [([], 0.5), ([(5, 1, 0), (9, 1, 0)], 1.0), ([(9, 0, 0), (9, 0, 1)], 0.0)])
def test_classifier_without_two_classes(odd_docs, odd_rows, labels_of, rows, score):
    got = qc.classify(odd_docs, labels_of(rows)).collect()
    assert len(got) == len(odd_rows) and {r.score for r in got} == {score}


def test_classifier_on_odd_rows_and_empty_tables(odd_docs, odd_rows, no_docs, labels_of):
    labels = labels_of([(2, 0, 0), (5, 1, 0), (5, 0, 0), (8, 0, 1), (9, 0, 0), (6, 1, 0), (None, 1, 1), (3, None, 1)])
    got = qc.classify(odd_docs, labels).collect()
    assert len(got) == len(odd_rows) and all(0 <= r.score <= 1 for r in got)
    kept = qc.good_documents(odd_docs, labels)
    assert kept.schema == odd_docs.schema and kept.count() == sum(r.predicted for r in got)
    assert qc.classify(no_docs, labels).count() == 0 and qc.good_documents(no_docs, labels_of([])).count() == 0
