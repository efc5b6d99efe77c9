"""Main text of web pages: flat text blocks classified by a decision tree over their and their neighbours' features."""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from certalog.llm.common import arrow_map, table

_NAME = re.compile(r"/?([A-Za-z][A-Za-z0-9:-]*)")
_PLAIN = re.compile(r"[^>\"'=]*")
_VALUE = re.compile(r"=\s*(?=([\"']?))")
#: Elements whose content is no text of the page, up to their end tag.
_RAW = frozenset("script style template title".split())
#: Elements that only mark up words within a block; all others end the block before and after them.
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark math meter nobr output q rp rt ruby "
    "s samp small span strike strong sub sup time tt u var wbr".split()
)
_VOID = frozenset("area base hr input link meta param source track embed col".split())
#: Elements that a start tag of their own kind or of a block may end.
_LOOSE = frozenset("p li tr td th dt dd option optgroup thead tbody tfoot html body".split())
_AWAY = frozenset("nav header footer aside form button select textarea fieldset dialog menu head".split())
_BODY = frozenset(("article", "main"))
#: Whole class, id or role tokens that mark menus, headers, footers, sidebars, notices, adverts, forms and comments.
_AWAY_TOKEN = frozenset(
    "ad ads advert adverts advertisement advertising adbox adslot ad-slot ad-box ad-container ad-banner adsense banner sponsor sponsored "
    "promo promotion nav navbar navigation main-nav top-nav site-nav nav-menu menu main-menu mainmenu breadcrumb breadcrumbs pagination "
    "pager header site-header page-header masthead footer site-footer page-footer contentinfo sidebar side-bar left-sidebar "
    "right-sidebar aside widget widgets complementary cookie cookies cookie-banner cookie-notice cookie-bar cookie-consent consent gdpr "
    "notice notices alert popup modal newsletter newsletter-signup subscribe subscription signup login form search search-form searchform "
    "searchbox comment comments comment-list commentlist reader-comments comments-area comments-section comment-form comment-body reply replies respond "
    "responses discussion disqus_thread share sharing share-buttons social social-links related related-posts related-articles "
    "recommended recommendations".split()
)
_NAMED = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)

#: Words of a block that is text for its length alone.
LONG = 24
FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "away", "place")
#: Labelled blocks: the features above, then 1 for main text. Words are counts and links the shares of the words that are in
#: links, of the block and of the ones before and after it (0, 0 beyond the page's ends); away says that the block is in a menu, header,
#: footer, sidebar, notice, advert, form or comment; place is 2 in the article element, 0 outside that of a page that has one, 1 on
#: a page that has none.
LABELLED = (
    # words, links, before, after, away, place, main
    (8, 0.0, 6, 1.0, 40, 0.0, 0, 2, 1),
    (120, 0.02, 40, 0.0, 80, 0.0, 0, 2, 1),
    (55, 0.05, 40, 0.0, 1, 0.0, 0, 2, 1),
    (1, 0.0, 55, 0.05, 60, 0.0, 0, 2, 1),
    (1, 0.0, 0, 0.0, 0, 0.0, 0, 2, 1),
    (3, 0.0, 70, 0.0, 5, 1.0, 0, 2, 1),
    (2, 0.0, 60, 0.0, 9, 0.1, 0, 2, 1),
    (12, 0.3, 90, 0.0, 100, 0.0, 0, 2, 1),
    (9, 1.0, 90, 0.0, 80, 0.0, 0, 2, 1),
    (4, 1.0, 30, 0.1, 25, 0.0, 0, 2, 1),
    (6, 0.8, 3, 0.0, 44, 0.0, 0, 2, 1),
    (2, 1.0, 12, 0.0, 9, 0.2, 0, 2, 1),
    (3, 0.0, 4, 0.0, 2, 0.0, 0, 2, 1),
    (2, 0.0, 1, 1.0, 3, 0.0, 0, 2, 1),
    (5, 0.0, 8, 1.0, 6, 0.0, 0, 2, 1),
    (1, 0.0, 2, 0.0, 1, 1.0, 0, 2, 1),
    (6, 0.1, 9, 0.0, 0, 0.0, 0, 2, 1),
    (4, 1.0, 50, 0.0, 5, 0.0, 0, 2, 1),
    (3, 1.0, 20, 0.0, 0, 0.0, 0, 2, 1),
    (3, 1.0, 4, 1.0, 2, 1.0, 0, 2, 0),
    (2, 1.0, 5, 1.0, 7, 0.9, 0, 2, 0),
    (8, 0.9, 6, 1.0, 8, 1.0, 0, 2, 0),
    (5, 1.0, 60, 0.0, 4, 1.0, 0, 2, 0),
    (7, 0.9, 80, 0.0, 6, 1.0, 0, 2, 0),
    (4, 1.0, 3, 1.0, 70, 0.0, 0, 2, 0),
    (1, 1.0, 2, 1.0, 9, 0.0, 0, 2, 0),
    (90, 0.05, 40, 0.0, 60, 0.0, 0, 1, 1),
    (35, 0.0, 7, 0.0, 50, 0.0, 0, 1, 1),
    (28, 0.1, 2, 1.0, 30, 0.0, 0, 1, 1),
    (24, 0.0, 45, 0.0, 2, 1.0, 0, 1, 1),
    (60, 0.2, 0, 0.0, 0, 0.0, 0, 1, 1),
    (4, 0.0, 0, 0.0, 0, 0.0, 0, 1, 1),
    (18, 0.0, 3, 0.0, 4, 0.0, 0, 1, 1),
    (6, 0.0, 1, 1.0, 55, 0.0, 0, 1, 1),
    (4, 0.0, 40, 0.0, 70, 0.0, 0, 1, 1),
    (3, 0.0, 3, 0.0, 30, 0.0, 0, 1, 1),
    (9, 0.0, 60, 0.0, 5, 0.0, 0, 1, 1),
    (8, 0.1, 35, 0.0, 26, 0.0, 0, 1, 1),
    (2, 0.0, 50, 0.0, 40, 0.1, 0, 1, 1),
    (7, 0.0, 30, 0.0, 3, 1.0, 0, 1, 1),
    (6, 0.0, 42, 0.0, 1, 1.0, 0, 1, 1),
    (5, 0.0, 3, 1.0, 2, 1.0, 0, 1, 0),
    (6, 0.0, 5, 0.0, 4, 0.0, 0, 1, 0),
    (3, 0.0, 0, 0.0, 1, 1.0, 0, 1, 0),
    (2, 0.0, 2, 0.0, 6, 0.0, 0, 1, 0),
    (8, 0.0, 4, 1.0, 0, 0.0, 0, 1, 0),
    (4, 0.0, 6, 0.9, 5, 0.0, 0, 1, 0),
    (7, 0.0, 8, 0.0, 0, 0.0, 0, 1, 0),
    (30, 0.8, 40, 0.0, 25, 0.0, 0, 1, 0),
    (22, 0.7, 15, 0.8, 12, 0.9, 0, 1, 0),
    (5, 0.6, 60, 0.0, 45, 0.0, 0, 1, 0),
    (1, 1.0, 0, 0.0, 1, 1.0, 0, 1, 0),
    (2, 1.0, 1, 1.0, 30, 0.0, 0, 1, 0),
    (3, 1.0, 55, 0.0, 2, 1.0, 0, 1, 0),
    (9, 0.9, 8, 1.0, 0, 0.0, 0, 1, 0),
    (1, 1.0, 0, 0.0, 1, 1.0, 1, 0, 0),
    (9, 0.0, 1, 1.0, 8, 0.0, 1, 0, 0),
    (9, 0.0, 40, 0.0, 30, 0.0, 1, 2, 0),
    (60, 0.0, 1, 1.0, 50, 0.0, 1, 1, 0),
    (80, 0.0, 60, 0.0, 70, 0.0, 1, 2, 0),
    (150, 0.05, 90, 0.0, 40, 0.0, 1, 1, 0),
    (12, 0.1, 55, 0.0, 0, 0.0, 1, 0, 0),
    (45, 0.0, 12, 0.0, 30, 0.0, 1, 1, 0),
    (3, 0.0, 40, 0.0, 60, 0.0, 1, 2, 0),
    (2, 0.0, 30, 0.0, 4, 1.0, 1, 2, 0),
    (9, 0.0, 1, 1.0, 8, 0.0, 0, 0, 0),
    (40, 0.0, 30, 0.0, 50, 0.0, 0, 0, 0),
    (90, 0.02, 60, 0.0, 3, 1.0, 0, 0, 0),
    (3, 0.0, 70, 0.0, 6, 0.0, 0, 0, 0),
    (2, 1.0, 3, 1.0, 4, 0.0, 0, 0, 0),
    (200, 0.0, 5, 0.0, 9, 0.0, 0, 0, 0),
    (25, 0.0, 60, 0.0, 80, 0.0, 0, 0, 0),
)


def fit_tree(rows=LABELLED):
    """A binary decision tree by least Gini impurity: (feature, threshold, below or equal, above), or a label at a leaf."""
    y = [r[-1] for r in rows]
    if len(set(y)) == 1:
        return y[0]
    best = None
    for f in range(len(rows[0]) - 1):
        values = sorted({r[f] for r in rows})
        for low, high in zip(values, values[1:]):
            cut = (low + high) / 2
            sides = [[r[-1] for r in rows if (r[f] <= cut) == below] for below in (True, False)]
            impurity = sum(2 * sum(s) * (len(s) - sum(s)) / len(s) for s in sides)
            if best is None or impurity < best[0] - 1e-12:
                best = (impurity, f, cut)
    if best is None:
        return int(2 * sum(y) >= len(y))
    _, f, cut = best
    return f, cut, fit_tree([r for r in rows if r[f] <= cut]), fit_tree([r for r in rows if r[f] > cut])


def label(tree, features) -> int:
    while not isinstance(tree, int):
        f, cut, below, above = tree
        tree = below if features[f] <= cut else above
    return tree


class _Tags:
    """The tags of a page in order, found in one pass; a page is read at most twice, whatever its quotes."""

    def __init__(self, page: str):
        self.page, self.quoted = page, True

    def end_of_tag(self, at: int) -> int:
        """Where the tag whose name ends at at has its '>', quoted values skipped; -1 if nowhere.

        Once a quote runs to the end of the page, quotes no longer count.
        """
        page = self.page
        start = at
        while self.quoted:
            at = _PLAIN.match(page, at).end()
            if at == len(page):
                self.quoted = False
            elif page[at] == ">":
                return at
            elif page[at] == "=":
                value = _VALUE.match(page, at)
                at = value.end()
                if value[1]:
                    close = page.find(value[1], at + 1)
                    if close < 0:
                        self.quoted = False
                    at = close + 1
            else:
                at += 1
        return page.find(">", start)

    def __iter__(self):
        """(start, end, name, is an end tag, attributes); name is empty for comments and declarations."""
        page, at = self.page, 0
        while True:
            start = page.find("<", at)
            if start < 0:
                return
            named = _NAME.match(page, start + 1)
            if named:
                close = self.end_of_tag(named.end())
                if close < 0:
                    return
                name, ends = named[1].lower(), page[start + 1] == "/"
                attrs = page[named.end() : close]
                at = close + 1
                if name in _RAW and not ends:
                    found = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
                    at = page.find(">", found.end()) + 1 if found else len(page)
                    at = at or len(page)
                yield start, at, name, ends, attrs
            elif page.startswith("<!--", start):
                close = page.find("-->", start + 4)
                at = close + 3 if close >= 0 else len(page)
                yield start, at, "", False, ""
            elif page[start + 1 : start + 2] in ("!", "?", "/"):
                close = page.find(">", start)
                at = close + 1 if close >= 0 else len(page)
                yield start, at, "", False, ""
            else:  # a sign like any other
                at = start + 1


class _Blocks:
    """Text blocks of one page, in page order: text, words, words in links, and the innermost element with a mark or role of its own."""

    def __init__(self, page: str):
        self.blocks: list[tuple[str, int, int, int]] = []
        self.parts: list[tuple[str, bool]] = []
        #: Elements with a mark or role: the one around, whether away by name, whether an article.
        self.around, self.away, self.body, self.form = [-1], [False], [False], [False]
        self.open: list[tuple[str, int]] = []
        self.counts: dict[str, int] = {}
        self.link, at = False, 0
        for start, end, name, ends, attrs in _Tags(page):
            self.text(page[at:start])
            at = end
            if name in _RAW:
                self.close_block()
            elif name:
                self.tag(name, ends, attrs)
        self.text(page[at:])
        self.close_block()

    def text(self, piece: str) -> None:
        if piece:
            self.parts.append((piece, self.link))

    def inside(self) -> int:
        return self.open[-1][1] if self.open else 0

    def tag(self, name: str, ends: bool, attrs: str) -> None:
        if name == "a":
            self.link = not ends
        if name in _INLINE:
            if name == "br":
                self.parts.append((" ", False))
            return
        self.close_block()
        self.link = False
        if ends:
            if self.counts.get(name):
                while True:
                    last = self.open.pop()[0]
                    self.counts[last] -= 1
                    if last == name:
                        return
        elif name not in _VOID:
            last = self.open[-1][0] if self.open else ""
            if last == "p" or (last == name and name in _LOOSE):
                self.open.pop()
                self.counts[last] -= 1
            self.push(name, attrs)

    def push(self, name: str, attrs: str) -> None:
        tokens = {t.lower() for a, b, c in _NAMED.findall(attrs) for t in (a or b or c).split()} if attrs else ()
        layout = name in ("html", "body", "main")
        away = not layout and (name in _AWAY or not _AWAY_TOKEN.isdisjoint(tokens))
        if name == "header" and self.body[self.inside()] and _AWAY_TOKEN.isdisjoint(tokens):
            away = False  # an article's own header has its title
        body = name in _BODY and not away
        if away or body:
            self.around.append(self.inside())
            self.away.append(away)
            self.body.append(body)
            self.form.append(name == "form")
            self.open.append((name, len(self.away) - 1))
        elif name in _LOOSE:
            return
        else:
            self.open.append((name, self.inside()))
        self.counts[name] = self.counts.get(name, 0) + 1

    def close_block(self) -> None:
        if not self.parts:
            return
        parts = [(html.unescape("".join(t)), link) for t, link in self.joined()]
        text = " ".join("".join(t for t, _ in parts).split())
        if text:
            words = sum(len(t.split()) for t, _ in parts)
            self.blocks.append((text, words, sum(len(t.split()) for t, link in parts if link), self.inside()))
        self.parts = []

    def joined(self):
        """Neighbouring pieces of the same kind as one, so that a character reference is never cut."""
        out: list[tuple[list[str], bool]] = []
        for t, link in self.parts:
            if out and out[-1][1] == link:
                out[-1][0].append(t)
            else:
                out.append(([t], link))
        return out

    def placed(self) -> list[tuple[bool, int]]:
        """(away, place) of each block.

        The article element with the most unlinked words is the page's; what is around it is layout, whatever its name. Without one, so
        is a form that holds most of the page.
        """
        size = [0] * len(self.away)
        for _, words, linked, e in self.blocks:
            size[e] += words - linked
        for e in range(len(size) - 1, 0, -1):
            size[self.around[e]] += size[e]
        bodies = [e for e in range(len(size)) if self.body[e]]
        lead = max(bodies, key=lambda e: (size[e], -e), default=0)
        layout, e = set(), self.around[lead]
        while e > 0:
            layout.add(e)
            e = self.around[e]
        if not bodies:
            layout |= {e for e in range(1, len(size)) if self.form[e] and 2 * size[e] > size[0]}
        away, body = [False], [False]
        for e in range(1, len(size)):
            away.append(away[self.around[e]] or (self.away[e] and e not in layout))
            body.append(body[self.around[e]] or self.body[e])
        return [(away[e], (2 if body[e] else 0) if bodies else 1) for *_, e in self.blocks]


def main_text(page: str | None, tree) -> str:
    """The main text of one page: its blocks that the tree labels so, one a line; empty if none."""
    if not page:
        return ""
    found = _Blocks(page)
    blocks, placed = found.blocks, found.placed()
    # a page without an article whose blocks are all short: words count by the longest of them that may be text
    own = [words for (_, words, linked, _), (away, place) in zip(blocks, placed) if place == 1 and not away and 2 * linked <= words]
    scale = max(1.0, LONG / max(own)) if own else 1.0
    sizes = [(0, 0.0), *((words * scale, min(1.0, linked / words)) for _, words, linked, _ in blocks), (0, 0.0)]
    kept = [
        block[0]
        for k, (block, where) in enumerate(zip(blocks, placed))
        if label(tree, (*sizes[k + 1], *sizes[k], *sizes[k + 2], *where))
    ]
    return "\n".join(kept)


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """The other columns of pages, with text in the place of the html column: the page's main text.

    Null and blank html give an empty text. Rows that repeat an id are extracted each by itself; a column named text of the input
    gives way to the result; an empty table gives an empty result. Markup that is never closed ends with the page, and a page takes
    time in proportion to its length.
    """
    tree = fit_tree()
    rest = [c for c in pages.columns if c not in (html_col, "text")]

    def run(batch: pa.RecordBatch):
        text = pa.array([main_text(p.as_py(), tree) for p in batch.column(len(rest))], pa.string())
        yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], text], names=[*rest, "text"])

    schema = pages.select(*rest).schema.add("text", "string")
    return arrow_map(pages.select(*rest, html_col), run, schema)


def op6_html(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
