import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tokentide.llm import toxicity as tx
from tokentide.llm.common import table
from tokentide.llm.queries import op8_toxicity

from .conftest import SF


def test_cumulative_link_fit_recovers_an_order():
    random = np.random.default_rng(4)
    n, weights = 4000, np.array([2.0, -1.0, 0.0])
    x = random.standard_normal((n, 3))
    score = x @ weights + random.logistic(size=n)
    grade = np.searchsorted([-1.0, 1.0, 2.5], score)
    number, row = np.tile(np.arange(3), n), np.repeat(np.arange(n), 3)
    fitted, cuts = tx.fit_ordinal(number, x.ravel(), row, grade, np.ones(n), 3)
    assert np.abs(fitted - weights).max() < 0.2 and np.abs(cuts - [-1.0, 1.0, 2.5]).max() < 0.25
    p = tx.Ordinal([], fitted, cuts).grades(x @ fitted)
    assert np.allclose(p.sum(axis=1), 1) and (p >= 0).all()


def test_vectors():
    v = tx.Vectors(["idiot", "idio*", "zz*"])
    numbers, values, marked = v.of("An IDIOT, idiots; other words 12 idiot".encode())
    assert dict(zip(numbers, values, strict=True)) == {0: math.log1p(2), 1: math.log1p(3)}
    assert marked == 3


def test_held_out_documents(spark):
    """Fitted on half of the labels of the largest driver table, right on the other half and quiet on clean documents.

    Each language has words of its own, so a few dozen toxic documents are too few to learn
    them all, and in this table some of their stems are also parts of ordinary words.
    """
    docs, labels = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    mine = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    model = tx.fit(docs, labels.where(mine))
    got = tx.severity(docs, model).join(labels.where(~mine).withColumnRenamed("toxic", "marked"), "doc_id")
    assert got.where("toxic and marked = 0").count() <= 0.01 * got.where("marked = 0").count()
    assert got.where("toxic and marked = 1").count() >= 0.8 * got.where("marked = 1").count()
    assert got.where("severity < 0 or severity > 3 or grade not between 0 and 3 or toxic != (p_toxic >= 0.5)").count() == 0


def test_odd_rows_and_empty_tables(odd_docs, odd_rows, no_docs, labels_of):
    labels = labels_of([(5, 1, 1), (5, 1, 0), (9, 0, 0), (2, 0, 0), (None, 0, 1), (4, 0, None), (1, 0, 1)])
    for marks in (labels, labels_of([]), labels_of([(5, 1, 0)])):
        got = tx.severity(odd_docs, tx.fit(odd_docs, marks)).collect()
        assert len(got) == len(odd_rows)
        assert marks is labels or not any(r.toxic for r in got)
    assert tx.severity(no_docs, tx.fit(no_docs, labels)).count() == 0


def plain_features(text):
    """By feature, how often it occurs; words are letters, a feature a word or its beginning."""
    counts = Counter()
    for word in re.findall(r"[^\W\d_]+", (text or "").lower()):
        counts.update([word] + [word[:k] + "*" for k in (4, 5, 6) if len(word) > k])
    return counts


def plain_choice(rows):
    """(text, toxic) -> features by falling likelihood-ratio statistic of their documents, equal ones by name."""
    seen = {1: Counter(), 0: Counter()}
    n = Counter(int(toxic == 1) for _, toxic in rows)
    for text, toxic in rows:
        seen[int(toxic == 1)].update(plain_features(text).keys())
    names, total = set(seen[0]) | set(seen[1]), n[0] + n[1]
    ranked = []
    for f in names:
        g = 0.0
        for k in (0, 1):
            for observed, of in ((seen[k][f], seen[0][f] + seen[1][f]), (n[k] - seen[k][f], total - seen[0][f] - seen[1][f])):
                g += 2 * observed * math.log(observed / (of * n[k] / total)) if observed else 0.0
        if seen[1][f] * n[0] > seen[0][f] * n[1] and g >= 2 * math.log(len(names) + 1):
            ranked.append((-g, f))
    return [f for _, f in sorted(ranked)][: tx.FEATURES], dict((f, -g) for g, f in ranked)


def plain_severity(model, text):
    counts = plain_features(text)
    score = sum(w * math.log1p(counts[f]) for f, w in zip(model.chosen, model.weights.tolist(), strict=True) if counts[f])
    upto = [1 / (1 + math.exp(-min(40, max(-40, t - score)))) for t in model.thresholds.tolist()] + [1.0]
    p = [b - a for a, b in zip([0.0, *upto], upto, strict=False)]
    return sum(k * x for k, x in enumerate(p)), p.index(max(p)), 1 - p[0]


def test_query_equals_a_plain_version(spark):
    """Features chosen and every document's severity, over a whole table with its labels."""
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    known = tx.sample(docs, labels)
    rows = [(r.text, r.toxic) for r in known.select("text", "toxic").collect()]
    chosen, statistic = plain_choice(rows)
    got = tx.choose(known)
    assert len(got) == len(chosen) and {round(statistic[f], 9) for f in got} == {round(statistic[f], 9) for f in chosen}
    assert all(statistic[a] >= statistic[b] - 1e-9 for a, b in zip(got, got[1:]))
    model = tx.fit(docs, labels)
    assert set(model.chosen) == set(got)
    scored = {r.doc_id: r for r in op8_toxicity(spark, SF).collect()}
    texts = docs.select("doc_id", "text").collect()
    assert len(scored) == len(texts)
    for doc_id, text in texts:
        row, (severity, grade, toxic) = scored[doc_id], plain_severity(model, text)
        assert abs(row.severity - severity) < 1e-6 and abs(row.p_toxic - toxic) < 1e-6
        assert row.toxic == (row.p_toxic >= 0.5) and (row.grade == grade or abs(row.severity % 1 - 0.5) < 0.2)
