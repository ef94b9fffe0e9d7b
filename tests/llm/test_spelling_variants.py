import random
import re
import zlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tokentide.llm import spelling_variants as sv
from tokentide.llm.common import table
from tokentide.llm.queries import op12_spelling_variants

from .conftest import SF


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    p = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[p + 1 :] == b[p + 1 :] if len(a) == len(b) else a[p:] == b[p + 1 :]


def plain_variants(words):
    """word -> (n, n_near, form, form_n, root), every pair compared that a missing character brings together."""
    near = {w: set() for w in words}
    by_rest = {}
    for w in words:
        for rest in {w, *(w[:k] + w[k + 1 :] for k in range(len(w)))}:
            by_rest.setdefault(rest, []).append(w)
    for some in by_rest.values():
        for a in some:
            near[a] |= {b for b in some if one_edit(a, b)}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None
    made = {}
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        made[w] = (n, len(near[w]), form[w], form[w] and words[form[w]], root)
    return made


def plain_words(rows, typos=True):
    count = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = run.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if typos and h % 97 == 0:
                k = h % len(word)
                word = word[:k] + word[k + 1 :]
            count[word] += 1
    return count


def listed(df):
    rows = df.collect()
    made = {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in rows}
    assert len(made) == len(rows)
    return made


letters = st.text(alphabet="abÿ", min_size=1, max_size=7)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="ab", max_size=3), st.sets(letters, min_size=1, max_size=30)), max_size=4))
def test_scan_equals_all_pairs(groups):
    lists = [(len(front), sorted((front + w).encode("latin-1") for w in some)) for front, some in groups]
    flat = [w for _, some in lists for w in some]
    starts = np.cumsum([0] + [len(some) for _, some in lists])[:-1].astype(np.int64)
    i, j = sv.scan(flat, starts, np.array([n for n, _ in lists], dtype=np.int64))
    want = [(s + x, s + y) for (_, some), s in zip(lists, starts.tolist()) for x in range(len(some)) for y in range(len(some)) if one_edit(some[x], some[y])]
    assert sorted(zip(i.tolist(), j.tolist())) == sorted(want)


def words_frame(spark, words):
    return spark.createDataFrame([(w, n) for w, n in words.items()], "word string, n bigint")


def invented(seed, n, alphabet, longest=9):
    rng = random.Random(seed)
    made = {"".join(rng.choice(alphabet) for _ in range(rng.randrange(5, longest))): rng.randrange(3, 60) for _ in range(n)}
    for w in list(made)[: n // 2]:  # edits of other words, chains among them
        k = rng.randrange(len(w))
        made.setdefault(rng.choice([w[:k] + "a" + w[k:], w[:k] + "b" + w[k + 1 :], w[:k] + w[k + 1 :] + "a"]), rng.randrange(3, 400))
    return {w: c for w, c in made.items() if len(w) >= 5}


def test_variants_equal_all_pairs(spark):
    for seed, alphabet in ((1, "ab"), (2, "abcdé"), (3, "aß")):
        words = invented(seed, 500, alphabet)
        assert listed(sv.variants(words_frame(spark, words))) == plain_variants(words)


def test_split_groups_change_nothing(spark):
    words = invented(4, 1500, "ab", 12)
    want = plain_variants(words)
    assert listed(sv.variants(words_frame(spark, words), group_words=20)) == want
    assert listed(sv.variants(words_frame(spark, words), group_words=1)) == want
    assert listed(sv.variants(words_frame(spark, words), group_bytes=400)) == want


def test_long_chains_have_one_root(spark):
    words = {"a" * k: 3 * 2 ** (k - 5) for k in range(5, 45)}
    got = listed(sv.variants(words_frame(spark, words)))
    assert got == plain_variants(words)
    assert {r[4] for r in got.values()} == {"a" * 44}


def test_ties_and_ratio(spark):
    words = {"house": 10, "housf": 10, "housg": 5, "mouse": 10, "houseg": 4, "moussé": 7, "mousse": 15}
    got = listed(sv.variants(words_frame(spark, words)))
    assert got == plain_variants(words)
    assert got["housg"] == (5, 3, "house", 10, "house")  # not housf, equally frequent
    assert got["house"][2] is None and got["moussé"][2] == "mousse"


def test_word_counts(spark, odd_docs, odd_rows, no_docs):
    for typos in (False, True):
        got = {r["word"]: r["n"] for r in sv.word_counts(odd_docs, typos).collect()}
        assert got == dict(plain_words(odd_rows, typos))
    assert sv.word_counts(no_docs).count() == 0 and listed(sv.spelling_variants(no_docs)) == {}


def test_many_typos(spark, make_docs):
    rng = random.Random(9)
    rows = [(d, " ".join(rng.choice(["Über", "ÀÿÀÿÀ", "strasse", "Straße", "x", "wordy" * 20, "Ünïcode"]) for _ in range(30))) for d in range(400)]
    got = {r["word"]: r["n"] for r in sv.word_counts(make_docs(rows).repartition(3), True).collect()}
    assert got == dict(plain_words(rows)) and len(got) > 12


def test_held_words_are_handed_on(spark, make_docs, monkeypatch):
    rows = [(d, f"alpha beta gamma w{d}") for d in range(50)]
    whole = dict(plain_words(rows, False))
    assert {r["word"]: r["n"] for r in sv.word_counts(make_docs(rows).coalesce(1)).collect()} == whole


def test_long_words(spark, make_docs):
    long = "x" * 100_000
    rows = [(d, f"{long} {long}y {long[1:]} {long}") for d in range(2)] + [(5, f"{long}y")]
    got = listed(sv.spelling_variants(make_docs(rows)))
    assert got == {long: (4, 1, None, None, long), long + "y": (3, 1, None, None, long + "y")}


def test_query_equals_a_plain_version(spark):
    rows = [tuple(r) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
    words = {w: n for w, n in plain_words(rows).items() if n >= 3 and len(w) >= 5}
    got = listed(op12_spelling_variants(spark, SF))
    assert got == plain_variants(words)
    assert sum(r[2] is not None for r in got.values()) > 50
