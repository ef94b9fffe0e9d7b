"""Licence scan: Dice coefficient over word bigrams against licence templates.

Units of a document are its lines, its paragraphs (lines between lines without
words) and the whole text, as word ranges. Words are normalised: A-Z lower-cased,
punctuation dropped, "licence" spelt "license". The coefficient of a unit with a
template is twice their shared bigrams (repeats counted) over the sum of their
bigrams; a match has at least ``MIN_DICE``. Size bounds prune first: with d the
least coefficient, a template can only match units of d/(2-d) to (2-d)/d times its
bigrams, and a unit needs a share of d/(2-d) of bigrams that any template has.

Sentences of a paragraph that are not a unit by themselves are looked at too, so a
notice counts that shares its line with other words or goes on over a line end. They
are given apart from the units and count for the best match of the document.

Defined cases: a null or empty text has no units and no match; ties go to the higher
coefficient, then the first name; a null doc_id stays null;
repeated rows get a row each; an empty table gives no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from importlib.resources import files

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from .common import per_document, texts_of

MIN_DICE = 0.8

# Notices and short texts of public licences, by SPDX name.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation the '
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and "
        "this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later "
        "version.",
    ),
    (
        "GPL-2.0",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later "
        "version.",
    ),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the '
        "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, "
        "compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, "
        "commercial or non-commercial, and by any means.",
    ),
)
#: Standard headers and notices of further versions.
HEADERS: tuple[tuple[str, str], ...] = (
    ("GPL-1.0", "This work is licensed under the GNU General Public License, version 1."),
    ("LGPL-2.0", "This work is licensed under the GNU Library General Public License, version 2."),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    *(
        (
            name,
            f"This {work} is free software{mark} you can redistribute it and/or modify it under the terms of the GNU {kind} Public "
            f"License as published by the Free Software Foundation{stop} either version {version} of the License, or (at your option) "
            f"any later version.{warranty}",
        )
        for name, work, kind, version, mark, stop in (
            ("GPL-1.0", "program", "General", "1", ";", ";"),
            ("GPL-2.0", "program", "General", "2", ";", ";"),
            ("GPL-3.0", "program", "General", "3", ":", ","),
            ("AGPL-3.0", "program", "Affero General", "3", ":", ","),
            ("LGPL-2.0", "library", "Library General", "2", ";", ";"),
            ("LGPL-2.1", "library", "Lesser General", "2.1", ";", ";"),
            ("LGPL-3.0", "program", "Lesser General", "3", ":", ","),
        )
        for warranty in (
            "",
            f" This {work} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
            f"MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind} Public License for more details.",
        )
    ),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed "
        "with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the '
        "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law "
        'or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR '
        "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and "
        "limitations under the License.",
    ),
)
#: Licences whose whole text is in the folder ``licenses``.
TEXTS = (
    "AGPL-3.0", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC0-1.0", "GPL-1.0", "GPL-2.0", "GPL-3.0",
    "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "MIT", "MPL-1.1", "MPL-2.0",
)


def whole_texts() -> tuple[tuple[str, str], ...]:
    return tuple((name, (files(__package__) / "licenses" / f"{name}.txt").read_text("utf-8")) for name in TEXTS)


COMMON = TEMPLATES + HEADERS + whole_texts()
SPELLING = {b"licence": b"license", b"licences": b"licenses", b"licenced": b"licensed"}

_KEPT = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 or b == 10 else 32 for b in range(256))


def lines_of(text: bytes) -> list[list[bytes]]:
    """Normalised words by line."""
    return [[SPELLING.get(w, w) for w in line.split()] for line in text.translate(_KEPT).split(b"\n")]


#: Ends a sentence: a mark, closing quotes and brackets, white space. Stands as a word of its own.
_STOP, _STOPS = b"\x7f", re.compile(rb"(?<=[.!?])[)\]\"']*(?=\s)")
_KEPT_STOP = _KEPT[:127] + _STOP + _KEPT[128:]


def sentences_of(text: bytes) -> list[tuple[int, int, int, int]]:
    """Sentences of paragraphs as ranges of the text's normalised words and of its lines."""
    marked = _STOPS.sub(b" \x7f ", text.replace(_STOP, b" ")).translate(_KEPT_STOP)
    found, at, first, last, begin = [], 0, None, None, 0
    for i, line in enumerate(marked.split(b"\n")):
        words = line.split()
        if first is not None and not any(w != _STOP for w in words):
            found.append((begin, at, first, last))
            first = None
        for w in words:
            if w != _STOP:
                if first is None:
                    first, begin = i, at
                at, last = at + 1, i
            elif first is not None:
                found.append((begin, at, first, last))
                first = None
    return found + [(begin, at, first, last)] * (first is not None)


def bigrams(words: list[bytes]) -> Counter:
    return Counter(zip(words, words[1:], strict=False))


class Scanner:
    """Finds the units that match a template."""

    def __init__(self, templates=TEMPLATES, min_dice: float = MIN_DICE):
        made = sorted(
            ((bigrams([w for line in lines_of(text.encode()) for w in line]), name) for name, text in templates),
            key=lambda t: (t[0].total(), t[1]),
        )
        self.templates = [t for t in made if t[0]]
        self.sizes = [t[0].total() for t in self.templates]
        self.min_dice, self.share = min_dice, min_dice / (2 - min_dice)
        self.number = {w: i for i, w in enumerate(sorted({w for t, _ in self.templates for pair in t for w in pair}), 1)}
        self.width = len(self.number) + 1
        known = {self.number[a] * self.width + self.number[b] for t, _ in self.templates for a, b in t}
        self.known = np.zeros(self.width * self.width, dtype=bool)
        self.known[list(known)] = True

    def best(self, words: list[bytes]) -> tuple[float, str] | None:
        """Coefficient and name of the best template of a unit, if it is a match."""
        own = bigrams(words)
        n, found = own.total(), None
        # all templates that the size bounds leave
        first, last = bisect_left(self.sizes, self.share * n - 1e-9), bisect_right(self.sizes, n / self.share + 1e-9)
        for template, name in self.templates[first:last]:
            shared = sum(min(k, own[pair]) for pair, k in template.items() if pair in own)
            dice = 2.0 * shared / (n + template.total())
            if dice >= self.min_dice and (found is None or (-dice, name) < (-found[0], found[1])):
                found = (dice, name)
        return found

    def units(self, lines: list[list[bytes]]) -> list[tuple[int, int]]:
        """Lines with words, paragraphs of more lines than one, and the whole text, as line ranges."""
        full = [i for i, line in enumerate(lines) if line]
        if not full:
            return []
        paragraphs, first = [], full[0]
        for a, b in zip(full, [*full[1:], None], strict=True):
            if b is None or b > a + 1:
                if a > first:
                    paragraphs.append((first, a))
                first = b
        whole = (full[0], full[-1])
        return [(i, i) for i in full] + paragraphs + [whole] * (whole not in paragraphs and len(full) > 1)

    def scan(self, text: bytes) -> tuple[int, list[tuple[str, float, int, int]]]:
        """Number of units, and (name, coefficient, first line, last line) of those that match."""
        if not self.templates:
            return len(self.units(lines_of(text))), []
        lines = lines_of(text)
        units = self.units(lines)
        counts = np.cumsum([0, *map(len, lines)])
        flat = [w for line in lines for w in line]
        ids = np.fromiter((self.number.get(w, 0) for w in flat), dtype=np.int64, count=len(flat))
        known = np.concatenate(([0, 0], np.cumsum(self.known[ids[:-1] * self.width + ids[1:]]))) if len(ids) else np.zeros(2, dtype=np.int64)
        found = []
        if known[-1] and units:
            first, last = np.array(units).T
            begin, end = counts[first], counts[last + 1]
            size = end - begin - 1
            shared = known[np.maximum(end, 1)] - known[begin + 1]
            open_ = (size >= self.share * self.sizes[0] - 1e-9) & (size <= self.sizes[-1] / self.share + 1e-9) & (shared >= self.share * size - 1e-9)
            for u in np.flatnonzero(open_).tolist():
                if best := self.best(flat[begin[u] : end[u]]):
                    found.append((best[1], best[0], *units[u]))
        return len(units), found

    def scan_sentences(self, text: bytes) -> list[tuple[str, float, int, int]]:
        """(name, coefficient, first line, last line) of the sentences that match and are no unit."""
        if not self.templates:
            return []
        lines = lines_of(text)
        counts = np.cumsum([0, *map(len, lines)]).tolist()
        flat = [w for line in lines for w in line]
        ids = np.fromiter((self.number.get(w, 0) for w in flat), dtype=np.int64, count=len(flat))
        if len(ids) < 2 or not (pairs := self.known[ids[:-1] * self.width + ids[1:]]).any():
            return []
        known = np.concatenate(([0], np.cumsum(pairs))).tolist()
        whole, found = {(counts[a], counts[b + 1]) for a, b in self.units(lines)}, []
        for begin, end, first, last in sentences_of(text):
            size = end - begin - 1
            if size < 1 or (begin, end) in whole or known[end - 1] - known[begin] < self.share * size - 1e-9:
                continue
            if best := self.best(flat[begin:end]):
                found.append((best[1], best[0], first, last))
        return found


_MATCHES = StructType(
    [StructField("license", StringType()), StructField("score", DoubleType()), StructField("first_line", LongType()), StructField("last_line", LongType())]
)


def scan_licenses(docs: DataFrame, templates=COMMON, min_dice: float = MIN_DICE) -> DataFrame:
    """Licence matches of every row of ``docs``; one pass, no shuffle.

    Columns: doc_id, n_units, license and score (of the best match, null without
    one), matches (license, score, first_line, last_line; lines count from 0) of the
    units and sentences (the same of sentences that are no unit).
    """
    fields = [
        StructField("n_units", LongType(), False),
        StructField("license", StringType()),
        StructField("score", DoubleType()),
        StructField("matches", ArrayType(_MATCHES), False),
        StructField("sentences", ArrayType(_MATCHES), False),
    ]

    def start():
        scanner = Scanner(templates, min_dice)

        def score(batch):
            texts = texts_of(batch)
            made, parts = [scanner.scan(t) for t in texts], [scanner.scan_sentences(t) for t in texts]
            best = [min([*found, *more], key=lambda m: (-m[1], m[0]), default=(None, None)) for (_, found), more in zip(made, parts, strict=True)]
            listed = [[[dict(zip(_MATCHES.names, m, strict=True)) for m in found] for found in some] for some in ([f for _, f in made], parts)]
            return [[n for n, _ in made], [b[0] for b in best], [b[1] for b in best], *listed]

        return score

    return per_document(docs, fields, start)


def oracle(documents: str = "documents", templates=TEMPLATES, min_dice: float = MIN_DICE) -> str:
    """DuckDB SQL for doc_id, n_units, n_matches, license and score."""
    rows = ", ".join(f"({i}, '{name}', '{text.replace(chr(39), chr(39) * 2)}')" for i, (name, text) in enumerate(templates))
    words = "regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    spelt = "list_transform({0}, lambda w: CASE w WHEN 'licence' THEN 'license' WHEN 'licences' THEN 'licenses' WHEN 'licenced' THEN 'licensed' ELSE w END)"
    listed = lambda text: spelt.format(words.format(text))
    return f"""
WITH template AS (SELECT * FROM (VALUES {rows}) AS v(t, name, text)),
template_words AS (SELECT t, name, {listed("text")} AS words FROM template),
template_pairs AS (
  SELECT t, name, words[i] || ' ' || words[i + 1] AS pair, count(*) AS n
  FROM template_words, range(1, len(words)) AS r(i) GROUP BY ALL),
template_size AS (SELECT t, name, sum(n) AS size FROM template_pairs GROUP BY ALL),
docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM {documents}),
lines AS (
  SELECT r, i - 1 AS line, {listed("parts[i]")} AS words
  FROM (SELECT r, string_split(text, chr(10)) AS parts FROM docs) s, range(1, len(parts) + 1) AS q(i)),
filled AS (
  SELECT r, line, words, line - row_number() OVER (PARTITION BY r ORDER BY line) AS block FROM lines WHERE len(words) > 0),
ranges AS (
  SELECT r, line AS a, line AS b FROM filled
  UNION SELECT r, min(line), max(line) FROM filled GROUP BY r, block
  UNION SELECT r, min(line), max(line) FROM filled GROUP BY r),
unit_words AS (
  SELECT u.r, u.a, u.b, flatten(list(f.words ORDER BY f.line)) AS words
  FROM ranges u JOIN filled f ON f.r = u.r AND f.line BETWEEN u.a AND u.b GROUP BY ALL),
unit_pairs AS (
  SELECT r, a, b, words[i] || ' ' || words[i + 1] AS pair, count(*) AS n, any_value(len(words) - 1) AS size
  FROM unit_words, range(1, len(words)) AS q(i) GROUP BY ALL),
scores AS (
  SELECT u.r, u.a, u.b, s.name, 2.0::DOUBLE * sum(least(u.n, p.n)) / (any_value(u.size) + s.size) AS score
  FROM unit_pairs u JOIN template_pairs p USING (pair) JOIN template_size s ON s.t = p.t
  GROUP BY u.r, u.a, u.b, s.t, s.name, s.size),
matched AS (
  SELECT r, a, b, max(score) AS score FROM scores WHERE score >= {min_dice} GROUP BY ALL),
best AS (
  SELECT s.r, min_by(s.name, struct_pack(x := -s.score, y := s.name)) AS license, max(s.score) AS score
  FROM scores s WHERE s.score >= {min_dice} GROUP BY s.r)
SELECT d.doc_id, coalesce(n.n_units, 0)::BIGINT AS n_units, coalesce(m.n_matches, 0)::BIGINT AS n_matches, best.license, best.score
FROM docs d
LEFT JOIN (SELECT r, count(*) AS n_units FROM ranges GROUP BY r) n USING (r)
LEFT JOIN (SELECT r, count(*) AS n_matches FROM matched GROUP BY r) m USING (r)
LEFT JOIN best USING (r)
"""
