"""Main text of web pages: flat text blocks, classified by a decision tree.

A page is cut into blocks at tags that break a line. A block has its words and the share
of them inside links, the same of the block before and after it, the sums over the blocks
of its parent, and what surrounds it: an element or a name for the main part, for a page
header, or for other parts (menus, footers, sidebars, notices, adverts, forms, comments),
and whether it is a heading. A decision tree (Gini splits), trained when a task starts on
the small labelled table of ``labelled_pages``, tells which blocks are main text.

One pass where the pages are read, no shuffle. A page is read from front to back once,
whatever is left open in it; memory follows the slab or a single longer page (5 to 10
times its size).

A block's text: character references decoded, white space (any Unicode) turned into one
space, trimmed; ``br`` is white space. Kept blocks are joined by line ends in page order.
Defined cases: null, empty or blank html, and pages without main text, give an empty text.
Repeated rows each give a row; a null page_id or url stays null; an empty table gives no
rows; further columns are not read. What an unclosed comment, script or style holds is no
text; a tag that the page's end cuts off is left out; a ``<`` before anything but a tag is text.
"""

from __future__ import annotations

import re
from functools import cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import slabs
from .labelled_pages import TABLE

INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark math nobr output q rp rt "
    "ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base col embed hr link meta param source track".split())
#: Their content is no text. The first kind goes on to the page's end if it is not closed.
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
LEFT_OUT = frozenset("audio button canvas datalist noscript object select svg template video".split())
#: Elements that end an open one of the same set, up to the nearest list or table.
ENDS = {t: frozenset(some) for some in (("li",), ("dt", "dd"), ("td", "th"), ("tr",), ("option",)) for t in some}
HOLDS = frozenset("ul ol menu dl table tbody thead tfoot".split())
#: Blocks whose parent has the text around them.
LEAVES = frozenset("p li h1 h2 h3 h4 h5 h6 dt dd td th div blockquote pre figcaption caption summary section".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

#: Elements inside one another; what is opened further in stands beside the innermost, as in browsers.
DEEPEST = 512

# what surrounds a block
PLAIN, HEADER, OTHER = 0, 1, 2
TAGS = {"header": HEADER} | dict.fromkeys("nav aside footer form menu dialog".split(), OTHER)
ROLES = {"banner": HEADER} | dict.fromkeys("navigation contentinfo complementary search form dialog alert alertdialog menu menubar".split(), OTHER)
HEADER_NAMES = frozenset("header head masthead".split())
OTHER_NAMES = re.compile(
    r"(ad|ads|adv|adslot|adsense|advert\w*|banner\w*|sponsor\w*|promo\w*|outbrain|taboola|cookie\w*|consent|gdpr|notice\w*|alert|comment\w*"
    r"|reply|replies|respond|disqus|discussion|sidebar\w*|aside|menu\w*|nav|navbar|navigation|breadcrumb\w*|foot|footer\w*|topbar|toolbar|share|sharing"
    r"|social\w*|related\w*|recommend\w*|newsletter|subscri\w*|signup|popup|modal|overlay|login|search\w*|widget\w*|pagination|pager|copyright|skip"
    r"|sitemap|tagcloud)$"
)
MAIN_NAMES = frozenset("article content main post entry story body text articlebody maincontent".split())
#: A name after one of these says something about the page, not about the element.
ABOUT_PAGE = frozenset("no has with without hide show open closed".split())
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_STOP = re.compile("[>\"']")
_IDEOGRAPH = re.compile("[぀-ヿ㐀-鿿]")


class Element:
    """An open element: its parent, what it says of its blocks, and sums over them."""

    __slots__ = ("tag", "parent", "depth", "kind", "main", "wraps", "words", "linked", "_around")

    def __init__(self, tag: str, parent: Element | None, kind: int = PLAIN, main: int = 0):
        self.tag, self.parent, self.kind, self.main = tag, parent, kind, main
        self.depth = parent.depth + 1 if parent else 0
        self.wraps = False  # a form around the main part
        self.words = self.linked = 0
        self._around: tuple[int, int] | None = None

    def around(self) -> tuple[int, int]:
        """(kind, main) of itself and all it lies in."""
        chain, e = [], self
        while e is not None and e._around is None:
            chain.append(e)
            e = e.parent
        kind, main = (PLAIN, 0) if e is None else e._around
        for e in reversed(chain):
            kind, main = max(kind, PLAIN if e.wraps else e.kind), max(main, e.main)
            e._around = (kind, main)
        return kind, main


def _named(tag: str, attributes: str) -> tuple[int, int]:
    """What an element's tag and attributes say: (kind, main); main is 2 for elements and roles, 1 for names."""
    kind, main = TAGS.get(tag, PLAIN), 2 if tag in ("article", "main") else 0
    if len(attributes) < 3 or tag in ("html", "body"):
        return kind, main
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "role":
            kind, main = max(kind, ROLES.get(value.lower(), PLAIN)), 2 if value.lower() in ("main", "article") else main
        elif name == "itemprop" and value.lower() == "articlebody":
            main = 2
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and "display:none" in value.replace(" ", "").lower():
            kind = OTHER
        elif name in ("class", "id"):
            for one in re.sub(r"([a-z])([A-Z])", r"\1-\2", value).split():
                parts = [p for p in re.split("[^a-z]+", one.lower()) if p]
                if not parts or parts[0] in ABOUT_PAGE or parts[-1] in ABOUT_PAGE:
                    continue
                if tag in ("article", "main"):
                    parts = parts[:1]  # later parts of the name of a main element tell its place or state
                if any(map(OTHER_NAMES.match, parts)):
                    kind = OTHER
                elif not HEADER_NAMES.isdisjoint(parts):
                    kind = max(kind, HEADER)
                elif not MAIN_NAMES.isdisjoint(parts):
                    main = max(main, 1)
    return kind, main


def _n_words(text: str) -> int:
    """Words; of scripts without spaces, two characters count as one."""
    n = text.count(" ") + 1 if text else 0
    return n if text.isascii() else n + len(_IDEOGRAPH.findall(text)) // 2


class Blocks:
    """Blocks of a page: (text, words, linked words, element)."""

    def __init__(self, html: str):
        self.made: list[tuple[str, int, int, Element]] = []
        self.at: Element = Element("", None)
        self.parts: list[str] = []
        self.linked_parts: list[str] = []
        self.in_link = False
        self._read(html)
        self._close()

    def _close(self) -> None:
        """End the block that is being read."""
        if self.parts:
            if text := " ".join("".join(self.parts).split()):
                n = _n_words(text)
                linked = min(n, _n_words(" ".join(" ".join(self.linked_parts).split()))) if self.linked_parts else 0
                self.made.append((text, n, linked, self.at))
                group = self.at.parent if self.at.tag in LEAVES and self.at.parent else self.at
                group.words += n
                group.linked += linked
            self.parts, self.linked_parts = [], []

    def _text(self, raw: str) -> None:
        if raw:
            text = unescape(raw) if "&" in raw else raw
            self.parts.append(text)
            if self.in_link:
                self.linked_parts.append(text)

    def _open(self, tag: str, attributes: str) -> None:
        self._close()
        if self.at.tag in ("p", *HEADINGS):  # hold no blocks
            self.at, self.in_link = self.at.parent, False
        if ends := ENDS.get(tag):
            e = self.at
            while e.parent and e.tag not in ends and e.tag not in HOLDS:
                e = e.parent
            if e.tag in ends:
                self.at, self.in_link = e.parent, False
        if self.at.depth == DEEPEST:
            self.at = self.at.parent
        kind, main = _named(tag, attributes)
        self.at = Element(tag, self.at, kind, main)
        if main == 2 or tag == "h1":
            e = self.at.parent
            while e and not e.wraps:
                e.wraps = e.tag == "form"
                e = e.parent

    def _end(self, tag: str) -> None:
        self._close()
        e = self.at
        while e.parent and e.tag != tag:
            e = e.parent
        if e.parent:
            self.at, self.in_link = e.parent, False

    def _read(self, html: str) -> None:
        at, last_quote = 0, {q: html.rfind(q) for q in "\"'"}
        unclosed: set[str] = set()
        while (lt := html.find("<", at)) >= 0:
            self._text(html[at:lt])
            tag = _TAG.match(html, lt)
            if not tag:
                if html.startswith("<!--", lt):
                    end = html.find("-->", lt + 2)
                    at = end + 3
                elif html.startswith(("<!", "<?", "</"), lt):
                    end = html.find(">", lt)
                    at = end + 1
                else:
                    self._text("<")
                    end = at = lt + 1
                if end < 0:
                    return
                continue
            # quotes hide a > only as values
            end = tag.end()
            while (stop := _STOP.search(html, end)) and stop[0] != ">":
                is_value = html[end : stop.start()].rstrip().endswith("=")
                end = stop.end()
                if is_value and end <= last_quote[stop[0]]:
                    end = html.index(stop[0], end) + 1
            if not stop:
                return
            closing, name, attributes = tag[1], tag[2].lower(), html[tag.end() : stop.start()]
            at = stop.end()
            if closing:
                if name == "a":
                    self.in_link = False
                elif name not in INLINE and name != "br":
                    self._end(name)
            elif name == "a":
                self.in_link = True
            elif name == "br":
                self._text(" ")
            elif name in INLINE:
                pass
            elif name in RAW or name in LEFT_OUT:
                found = None if name in unclosed else re.compile(f"</{name}(?=[\\s/>])", re.IGNORECASE).search(html, at)
                if found:
                    at = found.start()
                    close = html.find(">", at)
                    if close < 0:
                        return
                    at = close + 1
                elif name in RAW:
                    return
                else:
                    unclosed.add(name)
            elif name in VOID:
                self._close()
            else:
                self._open(name, attributes)
        self._text(html[at:])


def features(blocks: list[tuple[str, int, int, Element]]) -> np.ndarray:
    """A row for each block of a page: words, share in links, and those before it, after it and of its parent; kind, main part, page with main part, heading."""
    n = len(blocks)
    made = np.zeros((n, 12))
    if not n:
        return made
    words = np.array([b[1] for b in blocks], dtype=float)
    density = np.array([b[2] for b in blocks]) / words
    made[:, 0], made[:, 1] = words, density
    made[1:, 2], made[1:, 3], made[:-1, 4], made[:-1, 5] = words[:-1], density[:-1], words[1:], density[1:]
    groups = [b[3].parent if b[3].tag in LEAVES and b[3].parent else b[3] for b in blocks]
    sums = np.array([(g.words, g.linked) for g in groups], dtype=float)
    made[:, 6], made[:, 7] = sums[:, 0] - sums[:, 1], sums[:, 1] / sums[:, 0]
    around = np.array([b[3].around() for b in blocks])
    made[:, 8] = around[:, 0]
    # elements tell the main part; names do if they hold most of the text
    plain = np.where(around[:, 0] == OTHER, 0, words * (1 - density))
    strong, named = around[:, 1] == 2, around[:, 1] >= 1
    main = strong if plain[strong].sum() > 0 else named if plain[named].sum() * 2 >= plain.sum() > 0 else np.zeros(n, dtype=bool)
    made[:, 9], made[:, 10] = main, main.any()
    made[:, 11] = [b[3].tag in HEADINGS for b in blocks]
    return made


class Tree:
    """A binary decision tree with Gini splits, grown until leaves are pure or small."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 8, leaf: int = 2):
        self.share = float(y.mean()) if len(y) else 0.0
        self.split: tuple[int, float] | None = None
        if depth and 0 < self.share < 1 and (best := self._best(x, y, leaf)):
            self.split = best
            low = x[:, best[0]] <= best[1]
            self.low, self.high = Tree(x[low], y[low], depth - 1, leaf), Tree(x[~low], y[~low], depth - 1, leaf)

    @staticmethod
    def _best(x: np.ndarray, y: np.ndarray, leaf: int) -> tuple[int, float] | None:
        n, found = len(y), (2 * y.mean() * (1 - y.mean()) - 1e-9, None)
        for k in range(x.shape[1]):
            order = np.argsort(x[:, k], kind="stable")
            v, good = x[order, k], np.cumsum(y[order])
            cut = np.flatnonzero(v[1:] > v[:-1]) + 1  # rows below each split
            cut = cut[(cut >= leaf) & (n - cut >= leaf)]
            if not len(cut):
                continue
            a, b = good[cut - 1] / cut, (good[-1] - good[cut - 1]) / (n - cut)
            gini = (2 * a * (1 - a) * cut + 2 * b * (1 - b) * (n - cut)) / n
            i = int(np.argmin(gini))
            if gini[i] < found[0]:
                found = (gini[i], (k, float(v[cut[i] - 1] + v[cut[i]]) / 2))
        return found[1]

    def shares(self, x: np.ndarray) -> np.ndarray:
        """Of each row, the share of main text in its leaf."""
        made = np.full(len(x), self.share)
        if self.split:
            low = x[:, self.split[0]] <= self.split[1]
            made[low], made[~low] = self.low.shares(x[low]), self.high.shares(x[~low])
        return made


def labelled_blocks(table: list[tuple[str, float]] = TABLE) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows and labels of a labelled table."""
    rows, labels = [], []
    for page, size in table:
        html = re.sub(r"\{(\d+)\}", lambda m, k=size: " ".join(["word"] * max(1, round(int(m[1]) * k))), page)
        blocks = Blocks(html).made
        labels += [b[0].startswith("§") for b in blocks]
        rows.append(features(blocks))
    return np.concatenate(rows), np.array(labels, dtype=float)


@cache
def classifier() -> Tree:
    return Tree(*labelled_blocks())


def main_texts(pages: list[str | None]) -> list[tuple[str, int, int]]:
    """Of each page: its main text, its blocks and those kept."""
    cut = [Blocks(html or "").made for html in pages]
    x = np.concatenate([features(blocks) for blocks in cut]) if cut else np.zeros((0, 12))
    keep = classifier().shares(x) >= 0.5 if len(x) else np.zeros(0, dtype=bool)
    made, start = [], 0
    for blocks in cut:
        own = [b[0] for b, kept in zip(blocks, keep[start : start + len(blocks)].tolist(), strict=True) if kept]
        made.append(("\n".join(own), len(blocks), len(own)))
        start += len(blocks)
    return made


def extract(pages: DataFrame) -> DataFrame:
    """Main text of every row of ``pages`` (page_id, url, html).

    Columns: page_id, url, text, n_chars (code points of text), n_blocks, n_kept.
    """
    counts = [StructField(n, LongType(), False) for n in ("n_chars", "n_blocks", "n_kept")]
    schema = StructType([pages.schema["page_id"], pages.schema["url"], StructField("text", StringType(), False), *counts])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for part in slabs(batches, column="html"):
            html = [(t or b"").decode("utf-8", "replace") for t in part.column("html").cast(pa.binary()).to_pylist()]
            text, blocks, kept = zip(*main_texts(html), strict=True)
            columns = [list(text), [len(t) for t in text], list(blocks), list(kept)]
            made = [pa.array(c, type=f.type) for c, f in zip(columns, list(arrow)[2:], strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), *made], schema=arrow)

    return pages.select("page_id", "url", "html").mapInArrow(run, schema)
