import random
import tracemalloc

import numpy as np
import pytest

from tokentide.llm import decontamination as d

random.seed(5)
CUT = 4096


def plain(documents, items, window):
    out = []
    for words in documents:
        hit, found, longest = set(), set(), {}
        for name, item in items:
            n = min(window, len(item))
            for i in range(len(item) - n + 1 if item else 0):
                for j in range(len(words) - n + 1):
                    if words[j : j + n] == item[i : i + n]:
                        hit.update(range(j, j + n))
                        found.add(name)
                        k = n
                        while i + k < len(item) and words[j + k : j + k + 1] == item[i + k : i + k + 1]:
                            k += 1
                        longest[name] = max(longest.get(name, 0), k)
        out.append((sorted(hit), longest))
    return out


def words(n, kinds):
    return [b"w%d" % random.randrange(kinds) for _ in range(n)]


def test_suffix_order_is_the_sorted_one():
    for kinds in (1, 2, 50, 10**6):
        ids = np.array([random.randrange(kinds) + 1 for _ in range(300)])
        got = [tuple(ids[i : i + 10]) for i in d.suffix_order(ids, 10)]
        assert got == sorted(got)
    assert len(d.suffix_order(np.zeros(0, dtype=np.int64), 10)) == 0


def test_found_equals_plain():
    for _ in range(200):
        kinds, window = random.choice([2, 3, 8]), random.choice([1, 2, 4, 6])
        documents = [words(random.randrange(0, 30), kinds) for _ in range(random.randrange(0, 6))]
        items = [(str(i), words(random.randrange(0, 9), kinds)) for i in range(random.randrange(0, 5))]
        found = d.Found(d.Queries([(a, 0, b) for a, b in items], window), documents)
        spans, matches = found.by_document()
        for (hit, longest), s, m, bad in zip(plain(documents, items, window), spans, matches, found.contaminated(), strict=True):
            assert [x for r in s for x in range(r["start"], r["end"])] == hit
            assert {x["item"]: x["n_words"] for x in m} == longest
            assert bad == bool(hit)


def plain_places(documents, items, window):
    """By document: each item's longest match, then the first in the document, then in the item."""
    out = []
    for words in documents:
        best = {}
        for name, item in items:
            n = min(window, len(item))
            for i in range(len(item) - n + 1 if item else 0):
                for j in range(len(words) - n + 1):
                    k = 0
                    while i + k < len(item) and words[j + k : j + k + 1] == item[i + k : i + k + 1]:
                        k += 1
                    if k >= n:
                        best[name] = min(best.get(name, (0, 0, 0)), (-k, j, i))
        out.append([{"item": name, "item_start": i, "start": j, "n_words": -k} for name, (k, j, i) in sorted(best.items())])
    return out


def test_places_equal_plain():
    """Also with items that share an id or a text, and with few different words."""
    for _ in range(300):
        kinds, window = random.choice([1, 2, 3, 8]), random.choice([1, 2, 4, 6])
        documents = [words(random.randrange(0, 25), kinds) for _ in range(random.randrange(1, 5))]
        items = [(str(i), words(random.randrange(0, 12), kinds)) for i in range(random.randrange(1, 5))]
        items += [("0", items[0][1]), ("1", words(7, kinds)), ("z", documents[0][2:])]
        _, matches = d.Found(d.Queries([(a, 0, b) for a, b in items], window), documents).by_document()
        assert matches == plain_places(documents, items, window)


def test_repeated_words_make_no_pairs():
    """Windows x occurrences would be 10^9 rows; a hundred items with one passage in a thousand documents."""
    item, document = [b"a"] * 5_000, [b"a"] * 200_000
    tracemalloc.start()
    found = d.Found(d.Queries([("1", 0, item)]), [document, [b"a"] * 9, [b"b", *item[:20]]])
    spans, matches = found.by_document()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert spans == [[{"start": 0, "end": 200_000}], [], [{"start": 1, "end": 21}]]
    assert matches == [[{"item": "1", "item_start": 0, "start": 0, "n_words": 5_000}], [], [{"item": "1", "item_start": 0, "start": 1, "n_words": 20}]]
    assert peak < 2 << 30
    passage = [b"p%d" % i for i in range(40)]
    items = [(str(k), 0, [b"q%d" % k, *passage, b"r%d" % k]) for k in range(100)]
    _, matches = d.Found(d.Queries(items), [[b"s%d" % k, *passage, b"t"] for k in range(1000)]).by_document()
    assert all([(m["item"], m["start"], m["n_words"]) for m in own] == [(i, 1, 40) for i in sorted(map(str, range(100)))] for own in matches)


def test_match_says_where_it_is():
    item = [b"i%d" % i for i in range(30)]
    document = [b"x", *item[5:25], b"y", *item[8:20]]
    _, (matches,) = d.Found(d.Queries([("7", 0, item)]), [document]).by_document()
    assert matches == [{"item": "7", "item_start": 5, "start": 1, "n_words": 20}]


def test_words():
    assert d.words_of("Ab-C9 É\x7fü_z\n".encode()) == [b"ab", b"c9", "É".encode(), "ü".encode(), b"z"]


@pytest.mark.parametrize("block_bytes", [d.BLOCK_BYTES, 60])
def test_blocks_give_the_same(spark, make_docs, block_bytes):
    """A benchmark of one block, and one of many passes."""
    items = [(i, " ".join(w.decode() for w in words(random.randrange(0, 18), 4))) for i in range(12)] + [(None, "lone item"), (3, None)]
    rows = [(i % 9, " ".join(w.decode() for w in words(random.randrange(0, 60), 4))) for i in range(20)] + [(None, "a lone item b"), (7, None)]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    got = d.find_matches(make_docs(rows), benchmark, block_bytes=block_bytes).collect()
    want = plain([(t or "").encode().split() for _, t in rows], [("" if i is None else str(i), (t or "").encode().split()) for i, t in items], 10)
    shape = lambda doc, n, hit, longest: (str(doc), n, hit, sorted(longest))
    assert sorted(shape(r.doc_id, r.n_words, [x for s in r.spans for x in range(s.start, s.end)], [m.item for m in r.matches]) for r in got) == sorted(
        shape(doc, len((t or "").split()), hit, longest) for (doc, t), (hit, longest) in zip(rows, want, strict=True)
    )
    kept = d.decontaminated(make_docs(rows), benchmark, block_bytes=block_bytes).collect()
    assert sorted(str((r.doc_id, r.text)) for r in kept) == sorted(str(r) for r, (hit, _) in zip(rows, want, strict=True) if not hit)


def test_long_item_is_cut_into_segments(spark, make_docs):
    item = [f"v{i}" for i in range(2 * CUT + 500)]
    benchmark = spark.createDataFrame([(1, " ".join(item))], "item_id bigint, text string")
    cut = CUT
    rows = [(1, " ".join(item[cut - 5 : cut + 5])), (2, " ".join(item[-10:])), (3, " ".join(item[-9:]))]
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in d.find_matches(make_docs(rows), benchmark).collect()}
    assert got == {1: [(0, 10)], 2: [(0, 10)], 3: []}


def test_long_item_over_several_blocks(spark, make_docs):
    """Matches longer than a segment, with lengths and starts, when segments are in different blocks."""
    cut = CUT
    item = [f"v{i}" for i in range(3 * cut + 500)]
    benchmark = spark.createDataFrame([(1, " ".join(item)), (2, "a short item")], "item_id bigint, text string")
    rows = [
        (1, " ".join(item)),
        (2, " ".join(["x", "y", *item[100 : 2 * cut + 50], "z a short item", *item[5:cut]])),
        (3, " ".join([*item[cut - 20 : cut + 20], "x", *item[cut - 30 : cut + 30]])),
        (4, " ".join([*item[: cut + 100], "x", *item[cut + 100 :]])),
        (5, "nothing of it"),
    ]
    got = {r.doc_id: [tuple(m) for m in r.matches] for r in d.find_matches(make_docs(rows), benchmark, block_bytes=40_000).collect()}
    assert d.Blocks(benchmark, block_bytes=40_000).n > 2
    assert got == {
        1: [("1", 0, 0, 3 * cut + 500)],
        2: [("1", 100, 2, 2 * cut - 50), ("2", 0, 2 * cut - 47, 3)],
        3: [("1", cut - 30, 41, 60)],
        4: [("1", cut + 100, cut + 101, 2 * cut + 400)],
        5: [],
    }


def test_odd_rows_and_empty_tables(spark, odd_docs, odd_rows, no_docs):
    benchmark = spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog and runs far"), (2, ""), (None, None)], "item_id bigint, text string")
    none = benchmark.limit(0)
    got = d.find_matches(odd_docs, benchmark).collect()
    assert len(got) == len(odd_rows) and sum(bool(r.spans) for r in got) == 4
    assert all(not r.spans for r in d.find_matches(odd_docs, none).collect())
    assert d.find_matches(no_docs, benchmark).count() == 0
    kept = d.decontaminated(odd_docs, benchmark)
    assert kept.schema == odd_docs.schema and kept.count() == len(odd_rows) - 4
    assert d.decontaminated(odd_docs, none).count() == len(odd_rows)
    assert d.decontaminated(no_docs, benchmark).count() == 0
