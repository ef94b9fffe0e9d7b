import random
from itertools import combinations

import pytest
import xxhash

from tokentide.llm import simhash

random.seed(3)


def plain_fingerprint(text):
    words = text.encode().lower().split()
    if not words:
        return 0
    n = min(4, len(words))
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + n]), seed=42) for i in range(len(words) - n + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_roots(prints):
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for a, b in combinations(sorted(set(prints)), 2):
        if ((a ^ b) & (1 << 64) - 1).bit_count() <= 4:
            root[max(find(a), find(b))] = min(find(a), find(b))
    return {p: find(p) for p in prints}


@pytest.mark.parametrize("text", ["", "  \n", "One", "a b c", "A b C d", "x y z w " * 50, "é\x0bÜ \x0c漢 字 q Q", "a\x1cb c\x85d e f"])
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode()) == plain_fingerprint(text)


@pytest.mark.parametrize("list_pairs", [1, 4, simhash.LIST_PAIRS])
def test_links_are_complete(spark, list_pairs):
    """Clusters, chains and lone fingerprints; long lists through points, short ones through pairs."""
    prints = {0, -1, 1 << 62}
    for _ in range(6):
        p = random.getrandbits(64)
        for _ in range(random.randrange(1, 25)):
            for b in random.sample(range(64), random.randrange(0, 5)):
                p ^= 1 << b
            prints.add(p - (1 << 64) if p >> 63 else p)
            if random.random() < 0.2:
                p = random.getrandbits(64)
    df = spark.createDataFrame([(p,) for p in prints], "fp bigint")
    want = plain_roots(prints)
    got = {r.fp: r.root for r in simhash.roots(df, list_pairs).collect()}
    linked = {p for p, r in want.items() if list(want.values()).count(r) > 1}
    assert set(got) == linked
    assert {frozenset(p for p in got if got[p] == r) for r in got.values()} == {frozenset(p for p in linked if want[p] == r) for r in {want[p] for p in linked}}


def test_long_chain(spark):
    """A path of fingerprints four bits apart is one component."""
    prints, p = [], 0
    for i in range(48):
        p ^= 1 << (i % 64)
        if i % 4 == 3:
            prints.append(p)
    got = simhash.roots(spark.createDataFrame([(p,) for p in prints], "fp bigint")).collect()
    assert {r.root for r in got} == {min(prints)} and len(got) == len(prints)


def test_near_duplicates(make_docs):
    text = " ".join(f"w{i}" for i in range(200))
    rows = [(9, text), (4, text), (4, text), (6, text + " end"), (1, "other words stand alone here"), (None, text), (2, None), (3, "")]
    got = [tuple(r) for r in simhash.near_duplicates(make_docs(rows)).collect()]
    prints = {t: plain_fingerprint(t or "") for _, t in rows}
    roots = plain_roots(list(prints.values()))
    want = []
    for d, t in rows:
        reach = [e for e, u in rows if roots[prints[u]] == roots[prints[t]] and e is not None]
        want.append((d, f"{prints[t]:016x}", min(reach)))
    assert sorted(got, key=str) == sorted(want, key=str)


def test_only_nulls_have_a_null_component(make_docs):
    assert [tuple(r) for r in simhash.near_duplicates(make_docs([(None, "a b c d e")])).select("doc_id", "component_id").collect()] == [(None, None)]


def test_one_of_each(make_docs):
    text = " ".join(f"w{i}" for i in range(200))
    rows = [(9, text), (4, text), (4, text), (1, "other words stand alone here"), (None, text), (2, None), (3, ""), (None, "lone text of a row without id")]
    kept = simhash.one_of_each(make_docs(rows))
    assert kept.columns == make_docs(rows).columns
    assert sorted([r.doc_id for r in kept.collect()], key=str) == [1, 2, 4, None]


def test_odd_rows_and_empty_table(odd_docs, odd_rows, no_docs):
    got = simhash.near_duplicates(odd_docs).collect()
    assert sorted((str(r.doc_id), r.fingerprint) for r in got) == sorted((str(d), f"{plain_fingerprint(t or ''):016x}") for d, t in odd_rows)
    assert simhash.near_duplicates(no_docs).count() == 0
    kept = simhash.one_of_each(odd_docs)
    assert kept.schema == odd_docs.schema
    assert len({plain_fingerprint(r.text or "") for r in kept.collect()}) == kept.count()
    assert simhash.one_of_each(no_docs).count() == 0
