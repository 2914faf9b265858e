"""Main text of web pages from flat text blocks and a decision tree.

A page is read as a flat run of tags and text.  Block-level tags end a block; each block has its words, its link density
(words inside links), the same two figures of the block before and after it, whether it is a heading, and what the tags
around it say, as three small numbers: the region it stands in (article, main, a name such as "post-content"), whether
the page has a stronger region that holds a fair share of its text, and marks of what is no main text (navigation,
aside, form, readers' comments, whole names such as "sidebar"; a part of a compound name is a hint only).  A mark around
an article says nothing about the article, and none counts that is around most of the page's text.  A decision tree over
these features, trained when first needed on the labelled layouts in this module, keeps or drops each block.

Pages are independent: no shuffle; memory is bounded by one Arrow batch.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgraph.llm._common import ship

_RAW = ("script", "style", "noscript", "template", "iframe", "svg", "math", "object", "textarea", "select", "title")
#: A quote opens a value only after an equals sign; one that is never closed takes the rest of the page, as in browsers.
_VALUES = r"(?:=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))|[^>])*+"
_TOKEN = re.compile(
    r"<!--(?P<comment>.*?)(?:-->|--!>|\Z)|<!(?P<declaration>[^>]*)(?:>|\Z)|<\?[^>]*(?:>|\Z)"
    rf"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attributes>{_VALUES})(?:>|\Z)|(?P<odd></[^>]*(?:>|\Z))",
    re.S,
)
_RAW_END = {n: re.compile(rf"</{n}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I) for n in _RAW}
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPACE = re.compile(r"\s+")
#: Tags that end a block of text.
_BLOCK = frozenset(
    "address article aside blockquote body button canvas caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html input label legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul video audio".split()
)
#: Tags with an end tag whose extent says something about the text in them.
_NESTED = frozenset("article aside body button details dialog div fieldset figure footer form header html label main menu nav ol section table td th ul a".split())
_VOID = frozenset("input hr".split())
#: How strongly something says that it is no part of the main text: a part of a compound name, a whole name or a tag,
#: and the readers' comments, which hold articles of their own.
HINT, MARK, COMMENTS = 1, 2, 3
#: How strongly a region says that it is the main text: by its name, as the main element, as an article.
NAMED, MAIN, ARTICLE = 1, 2, 3
_OUTSIDE_TAGS = frozenset("nav footer aside header form button fieldset menu dialog label".split())
_OUTSIDE_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar".split())
#: Names of classes and ids, whole or as the parts of compound ones.
_COMMENT_NAMES = frozenset("comment comments disqus replies reply respond discussion".split())
_OUTSIDE_NAMES = frozenset(
    "ad ads advert advertisement advertising adverts banner breadcrumb breadcrumbs byline captcha consent cookie cookies copyright disclaimer feedback footer form gdpr header legal login masthead menu modal nav navbar navigation newsletter notice notices pager pagination paywall popup promo promoted promotion recommended related share sharing sidebar signup social sponsor sponsored subscribe tags toolbar topbar widget widgets".split()
)
_INSIDE_NAMES = frozenset("article content entry main post story".split())
_BODY_NAMES = frozenset("body content text".split())
_NEGATION = frozenset("has no with without".split())


class Block(NamedTuple):
    text: str
    words: int
    density: float
    heading: bool
    inside: int
    #: How much stronger the page's main region is than those around the block: it lies outside of the former if above 0.
    gap: int
    mark: int


class _Element:
    """An open element that says something about the text in it; ``own`` counts its words outside of links."""

    __slots__ = ("tag", "region", "mark", "own")

    def __init__(self, tag: str, region: int, mark: int) -> None:
        self.tag, self.region, self.mark, self.own = tag, region, mark, 0


def _says(tag: str, attributes: str) -> tuple[int, int]:
    """(region, mark) of a start tag."""
    region = ARTICLE if tag == "article" else MAIN if tag == "main" else 0
    mark = MARK if tag in _OUTSIDE_TAGS else 0
    if attributes and tag not in ("html", "body"):
        for m in _ATTRIBUTE.finditer(attributes):
            name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if name in ("class", "id"):
                for token in value.split():
                    parts = re.split(r"[-_:]+", token)
                    if parts[0] in _NEGATION:
                        continue
                    if not _COMMENT_NAMES.isdisjoint(parts):
                        mark = COMMENTS
                    elif token in _OUTSIDE_NAMES:
                        mark = max(mark, MARK)
                    elif not _OUTSIDE_NAMES.isdisjoint(parts):
                        mark = max(mark, HINT)
                    elif token in _INSIDE_NAMES or (parts[0] in _INSIDE_NAMES and parts[-1] in _BODY_NAMES):
                        region = max(region, NAMED)
            elif name == "role":
                mark = max(mark, MARK * (value in _OUTSIDE_ROLES))
                region = max(region, MAIN * (value == "main"), ARTICLE * (value == "article"))
            elif name == "hidden" or (name == "aria-hidden" and value == "true"):
                mark = max(mark, MARK)
    return region, mark


def blocks_of(page: str) -> list[Block]:
    """Non-empty text blocks of a page in order; nothing of comments, scripts, styles and other raw elements."""
    found: list[tuple[str, int, int, bool, tuple[_Element, ...]]] = []
    pieces: list[tuple[str, bool]] = []
    stack: list[_Element] = []
    links = 0
    heading = ""

    def flush() -> None:
        if not pieces:
            return
        text = _SPACE.sub(" ", html.unescape("".join(p for p, _ in pieces))).strip()
        if text:
            n = text.count(" ") + 1
            linked = min(n, sum(len(html.unescape(p).split()) for p, a in pieces if a))
            around = tuple(e for e in stack if e.region or e.mark)
            for e in around:
                e.own += n - linked
            found.append((text, n, linked, bool(heading), around))
        pieces.clear()

    at = 0
    while True:
        m = _TOKEN.search(page, at)
        if (m.start() if m else len(page)) > at:
            pieces.append((page[at : m.start() if m else len(page)], links > 0))
        if not m:
            break
        at = m.end()
        tag = m["name"]
        if tag is None:
            continue
        tag = tag.lower()
        if m["close"]:
            if tag in _BLOCK:
                flush()
            if tag == heading:
                heading = ""
            if tag in _NESTED and any(e.tag == tag for e in stack):
                while True:
                    e = stack.pop()
                    links -= e.tag == "a"
                    if e.tag == tag:
                        break
            continue
        if tag in _BLOCK:
            flush()
            if links and tag in ("p", "li", "div", "article", "section"):  # an anchor left open
                links = 0
                stack = [e for e in stack if e.tag != "a"]
        elif tag == "br":
            pieces.append((" ", links > 0))
        if tag in _RAW:
            if not m["attributes"].rstrip().endswith("/"):
                end = _RAW_END[tag].search(page, at)
                at = end.end() if end else len(page)
            continue
        if tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            heading = tag
        if tag in _NESTED and tag not in _VOID:
            if tag == "a":
                links += 1
                stack.append(_Element(tag, 0, 0))
            else:
                region, mark = _says(tag, m["attributes"])
                if tag == "header" and mark == MARK and any(e.region == ARTICLE for e in stack):
                    mark = HINT  # the head of the article itself
                stack.append(_Element(tag, region, mark))
    flush()
    return _placed(found)


def _placed(found: list[tuple[str, int, int, bool, tuple[_Element, ...]]]) -> list[Block]:
    """Blocks with what the elements around them say.

    A region takes back what was said around it, but for comments.  An element that holds most of the page's text is no
    menu or notice, whatever its name.  The page's main region is the strongest one that holds a fifth of its text.
    """
    total = sum(n - linked for _, n, linked, _, _ in found)
    best, rows = 0, []
    for text, n, linked, heading, around in found:
        inside = mark = 0
        for e in around:
            if e.region and mark < COMMENTS:
                mark = 0
                if e.mark < COMMENTS:
                    inside = max(inside, e.region)
                    if 5 * e.own >= total:
                        best = max(best, e.region)
            if e.mark == COMMENTS or 2 * e.own <= total:
                mark = max(mark, e.mark)
        rows.append((text, n, linked / n, heading, inside, mark))
    return [Block(text, n, density, heading, inside, max(0, best - inside), mark) for text, n, density, heading, inside, mark in rows]


FEATURES = ("words", "density", "words_before", "density_before", "words_after", "density_after", "heading", "inside", "gap", "mark")


def features_of(blocks: list[Block]) -> list[tuple[float, ...]]:
    edge = Block("", 0, 0.0, False, 0, 0, 0)
    line = [edge, *blocks, edge]
    return [
        (b.words, b.density, a.words, a.density, c.words, c.density, float(b.heading), float(b.inside), float(b.gap), float(b.mark))
        for a, b, c in zip(line, line[1:], line[2:], strict=False)
    ]


#: Labelled layouts, written by hand after common kinds of pages: +12 stands for twelve words of the main text, -12 for
#: twelve words that are none.
LAYOUTS = [
    # a news page with an article: everything around it goes, one-word paragraphs in it stay
    "<nav><ul><li><a>-1</a><li><a>-2</a><li><a>-1</a></ul></nav><div class=ad>-8</div><article><h1>+7</h1><p>+60<p>+1<p>+35<p>+3</article><footer>-9</footer>",
    "<header><a>-2</a></header><div class=ad>-40</div><article><h1>+5</h1><p>+2<p>+140<p>+80<p>+12</article><footer>-30</footer>",
    # a note and a teaser that nothing marks, beside the article
    "<div>-12</div><article><h1>+9</h1><p>+45<p>+70</article><div><p>-55</div><div>-4</div>",
    "<div>-30</div><div>-25</div><article><p>+90<p>+1<p>+200</article><div>-60</div><div>-70</div>",
    # short paragraphs anywhere in an article, and a page of nothing else
    "<article><p>+1<p>+2<p>+60<p>+1<p>+1<p>+3</article>",
    "<nav><a>-1</a> <a>-2</a></nav><article><p>+2<p>+1<p>+6<p>+2</article><footer><a>-3</a> <a>-1</a></footer>",
    "<div>-3</div><article><p>+9<p>+1</article><div>-2</div>",
    "<article><p>+4</article>",
    "<div class=ad>-6</div><article><p>+11<p>+8<p>+1<p>+90</article><footer>-20</footer>",
    "<article><h2>+3</h2><p>+1<h2>+1</h2><p>+150<h3>+2</h3><p>+4</article><div>-3</div>",
    "<article><ul><li>+1<li>+2<li><a>+1</a><li>+1</ul><p>+7</article><div><a>-2</a></div>",
    # readers' comments after and inside the article
    "<article><h1>+6</h1><p>+120<p>+4<p>+50</article><section id=comments><h2>-1</h2><article><p>-40</article><article><p>-9</article></section>",
    "<article><h1>+6</h1><p>+100<p>+50<div class=comment-list><p>-60<p>-2<p>-35</div></article>",
    "<main><article><p>+80<p>+90</article><div id=disqus_thread><p>-50</div></main><footer>-12</footer>",
    # names that only look like those of a menu or notice, inside the article
    "<article><div class=note-header>+3</div><p>+60<section class=related-work><h2>+2</h2><p>+45<p>+6</section><p>+30</article>",
    "<article class=promo-story><h1>+8</h1><p>+70<p>+5<p>+40</article><aside><p>-30</aside>",
    "<article><header class=entry-header><h1>+5</h1><p>+12</header><p>+90<p>+40<div class=social-history><p>+25</div></article>",
    # real ones inside the article
    "<article><h1>+6</h1><p>+80<div class=share><a>-1</a> <a>-1</a></div><p>+60<aside><p>-35</aside><form><label>-2</label></form><p>+20<div class=newsletter>-14</div><footer>-6</footer></article>",
    "<article><p>+50<div class=ad-slot><a>-6</a></div><p>+60<ul class=share-buttons><li><a>-1</a><li><a>-1</a></ul><p>+2<div class=related-posts><a>-7</a><a>-6</a></div></article>",
    "<article><p>+50<nav><a>-3</a><a>-2</a></nav><p>+70<div class=notice>-20</div><p>+3<div class=tags><a>-1</a></div></article>",
    # links of the article itself
    "<article><p>+30<p><a>+4</a><p>+50<ul><li><a>+3</a> <li>+9<li><a>+5</a></ul><p>+20<blockquote>+15</blockquote></article>",
    # a main element without an article
    "<nav><a>-1</a> <a>-2</a></nav><main><h1>+4</h1><p>+60<p>+2<h2>+3</h2><p>+40<p>+8</main><footer>-10</footer><div>-25</div>",
    "<main><h1>+5</h1><p>+30<aside>-12</aside><p>+45<form>-5</form><div class=cookie-notice>-18</div></main><div class=cookie-notice>-20</div>",
    "<nav><a>-4</a></nav><main><p>+1<p>+2<p>+30<p>+3<p>+1</main>",
    # a region by its name only: link lists in it go
    "<div id=content><h1>+6</h1><p>+50<p>+3<p>+70<p>+10</div><div id=sidebar><p>-25<a>-3</a></div><div>-6</div>",
    "<div class=content><ul><li><a>-2</a><li><a>-1</a><li><a>-2</a></ul><h1>+5</h1><p>+40<p>+60<p>+5<ul><li><a>-3</a><li><a>-4</a></ul></div>",
    "<div class=site-header><a>-2</a></div><div class=post-content><p>+45<p>+1<p>+30<p>+60</div><div class=widget-area><p>-30</div><div class=site-footer>-12</div>",
    "<div id=sidebar><a>-3</a></div><div class=entry-content><p>+40<p>+2<p>+9</div>",
    "<div class=article-body><h1>+6</h1><p>+3<p>+50<p>+1</div>",
    # no region at all: running text with few links
    "<div><a>-1</a> <a>-1</a> <a>-2</a></div><h1>+5</h1><p>+40<p>+55<p>+3<p>+30<div><a>-2</a> <a>-2</a></div><div>-4</div>",
    "<table><tr><td><a>-2</a><td><a>-1</a></tr></table><p>+80 <a>+4</a><p>+25<h2>+3</h2><p>+120<table><tr><td><a>-3</a><td>-2</tr></table>",
    "<div>-3</div><div><a>-2</a></div><div>-2</div><div>+90</div><div>+2</div><div>+75</div><div><a>-4</a></div><div>-7</div>",
    "<div class=header><a>-3</a></div><p>+18 <a>+2</a><p>+22<p>+16<p>+200<div class=footer>-25</div>",
    "<ul><li><a>-2</a><li><a>-3</a><li><a>-8</a><li><a>-20</a></ul><p>-4<ul><li><a>-2</a></ul>",
    "<div class=cookie-notice><p>-22</div><div class=top-menu><a>-3</a></div><p>+33<p>+48<p>+27<div class=newsletter-box>-16</div>",
    "<p>+60<p>+18",
    "<div><a>-3</a></div><p>+80<p>+14<div><a>-2</a> <a>-1</a></div>",
    "<div><a>-1</a></div><p>+15<p>+40<p>+24<p>+13<ul><li><a>-2</a><li><a>-6</a></ul><div>-9</div>",
    "<p>+15<div><a>-2</a></div>",
    # a form or a layout class around the whole page
    "<form><div><a>-1</a> <a>-1</a></div><article><p>+60<p>+2<p>+30</article><div>-8</div></form>",
    "<form><div class=content-with-sidebar><h1>+4</h1><p>+70<p>+60<p>+2<p>+45</div><div class=sidebar><p>-20</div></form>",
]
_LABEL = re.compile(r"([+-])(\d+)")


def labelled_table() -> list[tuple[tuple[float, ...], int]]:
    """Rows of FEATURES of the blocks of LAYOUTS, and whether the block is main text."""
    rows = []
    for page in LAYOUTS:
        blocks = blocks_of(_LABEL.sub(lambda m: " ".join([m[1]] * int(m[2])), page))
        rows += [(x, int(b.text[0] == "+")) for b, x in zip(blocks, features_of(blocks), strict=True)]
    return rows


def train_tree(rows: list[tuple[tuple[float, ...], int]], least: int = 1, depth: int = 12):
    """A binary tree by Gini impurity: (feature, bound, below or equal, above), or the class of a leaf."""
    ones = sum(y for _, y in rows)
    major = int(2 * ones >= len(rows))
    if depth == 0 or ones in (0, len(rows)) or len(rows) < 2 * least:
        return major
    best = None
    for k in range(len(rows[0][0])):
        line = sorted((x[k], y) for x, y in rows)
        below = 0
        for i in range(1, len(line)):
            below += line[i - 1][1]
            if line[i - 1][0] == line[i][0] or i < least or len(line) - i < least:
                continue
            p, q = below / i, (ones - below) / (len(line) - i)
            gini = i * p * (1 - p) + (len(line) - i) * q * (1 - q)
            if best is None or gini < best[0] - 1e-12:
                best = (gini, k, (line[i - 1][0] + line[i][0]) / 2)
    if best is None:
        return major
    _, k, bound = best
    low, high = [r for r in rows if r[0][k] <= bound], [r for r in rows if r[0][k] > bound]
    return k, bound, train_tree(low, least, depth - 1), train_tree(high, least, depth - 1)


@lru_cache(maxsize=1)
def _tree():
    return train_tree(labelled_table())


def keeps(tree, x: tuple[float, ...]) -> bool:
    while not isinstance(tree, int):
        k, bound, low, high = tree
        tree = low if x[k] <= bound else high
    return bool(tree)


def main_text(page: str | None) -> str:
    """Blocks that the tree keeps, in page order, joined by two line feeds; empty if there are none."""
    if not page:
        return ""
    blocks, tree = blocks_of(page), _tree()
    return "\n\n".join(b.text for b, x in zip(blocks, features_of(blocks), strict=True) if keeps(tree, x))


def extract(df: DataFrame, id_col: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """page_id, url, text, n_chars: one row per row of ``df``.

    A null or empty page has an empty text.  Null ids and urls stay null, and an id that isn't a number is null; repeated rows give repeated rows; other columns
    aren't read; an empty table gives an empty table.  A page cut off in a tag, comment or reference is read as far as
    it goes.
    """
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(p.as_py()) for p in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = df.select(F.col(id_col).try_cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(page).cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
