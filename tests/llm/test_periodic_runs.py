import hashlib
import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tokentide.llm import periodic_runs
from tokentide.llm.common import WordIds, table
from tokentide.llm.queries import op13_periodic_runs

from .conftest import SF


def plain_runs(words, min_length=12):
    """All runs by trying every period at every place."""
    found = []
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            end = i + q
            if i > start and end - start >= max(min_length, 2 * q):
                if not any(words[start : end - r] == words[start + r : end] for r in range(1, q)):
                    found.append((start, end - start, q))
            i += i == start
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapse(words, runs):
    dropped = {i for start, length, q in runs for i in range(start + q, start + length)}
    return [w for i, w in enumerate(words) if i not in dropped]


def of_slab(documents, min_length=12):
    words = WordIds([[w.encode() for w in d] for d in documents])
    made = [[] for _ in documents]
    for start, end, q in periodic_runs.runs_of(words, min_length):
        d = int(words.document[start])
        made[d].append((start - int(words.starts[d]), end - start, q))
    return made


repeats = st.lists(st.sampled_from("abc"), min_size=1, max_size=9).flatmap(lambda u: st.integers(1, 9).map(lambda k: u * k))
documents = st.lists(st.lists(repeats, max_size=5).map(lambda parts: [w for p in parts for w in p]), max_size=5)


@settings(max_examples=300, deadline=None)
@given(documents, st.sampled_from([2, 6, 12]))
def test_runs_equal_a_plain_search(docs, min_length):
    assert of_slab(docs, min_length) == [plain_runs(d, min_length) for d in docs]


def test_run_shapes():
    one = ["a"] * 12
    assert of_slab([one, one[:11], ["a", "b"] * 6, ["a", "b"] * 6 + ["a"], [str(i) for i in range(40)] * 2]) == [
        [(0, 12, 1)],
        [],
        [(0, 12, 2)],
        [(0, 13, 2)],
        [(0, 80, 40)],
    ]
    # a run of one word at the end of a longer run; neighbours don't run into each other
    inner = (["a"] * 12 + ["b"]) * 3
    assert of_slab([inner, inner]) == [[(0, 12, 1), (0, 39, 13), (13, 12, 1), (26, 12, 1)]] * 2


def test_find_runs_of_odd_rows(odd_docs, no_docs):
    got = {(r["doc_id"], r["n_words"]): r for r in periodic_runs.find_runs(odd_docs).collect()}
    assert got[1, 0]["runs"] == [] and got[1, 0]["collapsed"] == ""
    assert got[9, 60_000]["runs"][0][:] == (0, 60_000, 3) and got[9, 60_000]["collapsed"] == "many words here"
    assert got[8, 1]["collapsed"] == "x" * 300_000
    assert periodic_runs.find_runs(odd_docs).count() == odd_docs.count()
    assert periodic_runs.find_runs(no_docs).count() == 0


def test_shuffled_rows_and_slabs_change_nothing(spark, make_docs):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice("abc") for _ in range(rng.randrange(60))) * rng.randrange(1, 4)) for i in range(300)]
    docs = make_docs(rows)
    whole = {r["doc_id"]: ([tuple(x) for x in r["runs"]], r["collapsed"]) for r in periodic_runs.find_runs(docs.coalesce(1)).collect()}
    assert whole == {r["doc_id"]: ([tuple(x) for x in r["runs"]], r["collapsed"]) for r in periodic_runs.find_runs(docs.repartition(7)).collect()}
    for doc_id, text in rows:
        words = text.split()
        assert whole[doc_id] == (runs := plain_runs(words), " ".join(collapse(words, runs)))


def test_a_long_run_stays_fast(make_docs):
    rows = [(1, "a " * 200_000), (2, "a b c d e f g " * 40_000 + "end")]
    got = {r["doc_id"]: [tuple(x) for x in r["runs"]] for r in periodic_runs.find_runs(make_docs(rows)).collect()}
    assert got == {1: [(0, 200_000, 1)], 2: [(0, 280_000, 7)]}


def planted(doc_id, text):
    words = [w.decode() for w in (text or "").encode().split()]
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return words
    a = h // 10 % n
    p = 1 + (n - a) // (3 + h // 10 % 8)
    return [words[i if i < a else a + (i - a) % p] for i in range(n)]


def test_planting(spark, make_docs, odd_rows):
    rows = [(d, t) for d, t in odd_rows if len(t or "") < 1000] + [(d, f"w{d} x y z " * (d % 7)) for d in range(20, 90)] + [(-7, "a b c")]
    got = sorted((r["doc_id"] or 0, (r["text"] or "").split()) for r in periodic_runs.plant_repeats(make_docs(rows)).collect())
    assert got == sorted((d or 0, planted(d, t)) for d, t in rows)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_query_equals_a_plain_version(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text").collect()
    got = {r["doc_id"]: r for r in op13_periodic_runs(spark, SF).collect()}
    assert len(got) == len(docs)
    some = 0
    for doc_id, text in docs:
        words = planted(doc_id, text)
        if len(words) > 2000:  # the plain search takes long there
            continue
        runs = plain_runs(words)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
        row = got[doc_id]
        assert row["n_runs"] == len(runs)
        assert (row["start"], row["length"], row["period"]) == (best or (None,) * 3)
        assert row["exponent_milli"] == (best and 1000 * best[1] // best[2])
        assert row["runs_sha256"] == sha("".join(f"{s},{n},{q}\n" for s, n, q in runs))
        assert row["collapsed_sha256"] == sha(" ".join(collapse(words, runs)))
        some += bool(runs)
    assert some > 10


def test_least_length(no_docs):
    with pytest.raises(ValueError):
        periodic_runs.find_runs(no_docs, 1)
