import random

from tokentide.llm import license_scan as li

random.seed(7)


def plain(text, templates, least):
    """Units by their definition, and every unit against every template."""
    lines = li.lines_of(text)
    full = [i for i, x in enumerate(lines) if x]
    units = {(i, i) for i in full}
    for a in full:
        for b in full:
            if a <= b and all(lines[i] for i in range(a, b + 1)) and (a == 0 or not lines[a - 1]) and (b + 1 == len(lines) or not lines[b + 1]):
                units.add((a, b))
    if full:
        units.add((full[0], full[-1]))
    found = set()
    for a, b in units:
        own = li.bigrams([w for line in lines[a : b + 1] for w in line])
        best = None
        for name, t in templates:
            other = li.bigrams([w for line in li.lines_of(t.encode()) for w in line])
            if own.total() and other.total():
                dice = 2 * (own & other).total() / (own.total() + other.total())
                if dice >= least and (best is None or (-dice, name) < best):
                    best = (-dice, name)
        if best:
            found.add((best[1], -best[0], a, b))
    return len(units), found


def test_scan_equals_plain():
    pieces = [t.split(" ") for _, t in li.TEMPLATES]
    scanner = li.Scanner()
    for _ in range(60):
        words = []
        for _ in range(random.randrange(1, 6)):
            piece = list(random.choice(pieces))
            for _ in range(random.randrange(0, 4)):
                piece[random.randrange(len(piece))] = random.choice(["other", "License", "\n", "word\n\nnext"])
            words += [*piece, random.choice([" ", "\n", "\n\n", "Some other prose.\n"])]
        text = " ".join(words).encode()
        n, found = scanner.scan(text)
        assert (n, set(found)) == plain(text, li.TEMPLATES, li.MIN_DICE)


def test_notice_in_prose():
    _, found = li.Scanner().scan("Some prose here.\n  released UNDER the mit licence!\nMore prose, more.".encode())
    assert found == [("MIT", 1.0, 1, 1)]


def test_multi_line_template_is_a_paragraph():
    text = dict(li.TEMPLATES)["Unlicense"].replace(", ", ",\n")
    _, found = li.Scanner().scan(("Read me\n\n" + text + "\n\nthe end").encode())
    assert ("Unlicense", 1.0) in {m[:2] for m in found}


def test_no_templates():
    assert li.Scanner(templates=()).scan(b"Released under the MIT License.") == (1, [])


def test_whole_texts_and_headers_get_their_own_name():
    scanner = li.Scanner(li.COMMON)
    for name, text in li.whole_texts() + li.HEADERS:
        found = scanner.scan(text.encode())[1]
        assert max((score, n) for n, score, *_ in found)[0] == 1.0
        assert {n for n, score, first, last in found if score == 1.0 and (first, last) != (0, 0) or "\n" not in text} >= {name}
    bsd = dict(li.whole_texts())["BSD-3-Clause"].replace("the copyright holder", "Foo Inc")
    found = scanner.scan(("Copyright (c) 2020, Foo Inc\nAll rights reserved.\n\n" + bsd).encode())[1]
    assert max(found, key=lambda m: m[3] - m[2])[0] == "BSD-3-Clause"
    assert scanner.scan(b"This work is licensed under the GNU General Public License, version 1.")[1] == [("GPL-1.0", 1.0, 0, 0)]


def test_sentence_in_a_line(make_docs):
    text = "Notes.\nCopyright 2020 Foo. Licensed under the MIT License. All of\nit is (licensed under the\nApache License, Version 2.0.) More."
    row = li.scan_licenses(make_docs([(1, text), (2, "Copyright 2020 Foo. Licensed under the MIT License.")])).sort("doc_id").collect()
    assert [tuple(m) for m in row[0].sentences] == [("MIT", 1.0, 1, 1)]
    assert (row[1].license, row[1].score, row[1].matches) == ("MIT", 1.0, []) and [tuple(m) for m in row[1].sentences] == [("MIT", 1.0, 0, 0)]
    assert li.Scanner().scan_sentences(b"See it. Licensed under\nthe MIT License. The end") == [("MIT", 1.0, 0, 1)]
    words = [w for line in li.lines_of(text.encode()) for w in line]
    assert [b" ".join(words[a:b]) for a, b, _, _ in li.sentences_of(text.encode())][1:3] == [b"copyright 2020 foo", b"licensed under the mit license"]


def test_odd_rows_and_empty_table(odd_docs, odd_rows, no_docs):
    got = li.scan_licenses(odd_docs).collect()
    assert len(got) == len(odd_rows) and all(r.license is None and r.score is None and not r.matches for r in got)
    assert sorted((str(r.doc_id), r.n_units) for r in got) == sorted((str(d), plain((t or "").encode(), (), 1)[0]) for d, t in odd_rows)
    assert li.scan_licenses(no_docs).count() == 0
