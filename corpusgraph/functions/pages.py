"""Web pages: the element that holds the content, and that content as text and as Markdown.

A page is parsed to a small tree once; everything else is read from it.  These are row functions for Python workers; the
table of a page's parts is ``corpusgraph.sources.web.page_parts``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

_SPACE = re.compile(r"\s+")
_VOID = frozenset({"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"})
#: What ends an open element of the same kind, as their end tags may be left out.
_ENDS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_ENDS_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split())


#: Levels of a tree at most, well below what recursion allows.
DEEPEST = 150


class Pattern(NamedTuple):
    """An element by its tag, id, class or role; ``inside`` another one, if that is given."""

    tag: str = ""
    id: str = ""
    cls: str = ""
    role: str = ""
    inside: Pattern | None = None


# Elements that hold a page's content, the best ones first, and what is left out inside them.
CONTENT = (
    Pattern(id="doc-content"), Pattern(cls="vp-doc"), Pattern(cls="markdown-body"), Pattern(cls="theme-default-content"), Pattern("div", role="main"), Pattern("main"), Pattern("article"),
    Pattern("div", cls="body", inside=Pattern("div", cls="document")), Pattern("div", cls="body"), Pattern("div", cls="contents"), Pattern("body"),
)
LEFT_OUT_TAGS = frozenset({"nav", "script", "style", "header", "footer", "aside"})
LEFT_OUT_CLASSES = frozenset({"related", "sphinxsidebar", "pager", "VPDocFooter", "VPSidebar"})
#: The real title of generated interface pages, whose h1 is the same on all of them.
NAMED_TITLE = Pattern(cls="title", inside=Pattern(cls="headertitle"))


class Element:
    """An element with its attributes and what it holds: elements and strings."""

    __slots__ = ("tag", "at", "holds", "up", "depth")

    def __init__(self, tag: str, at: dict[str, str], up: Element | None) -> None:
        self.tag, self.at, self.up = tag, at, up
        self.depth = up.depth + 1 if up else 0
        self.holds: list[Element | str] = []

    @property
    def classes(self) -> list[str]:
        return self.at.get("class", "").split()

    def walk(self) -> Iterator[Element]:
        """All elements below, in page order; no recursion, as pages may be nested at will."""
        line = [iter(self.holds)]
        while line:
            x = next(line[-1], None)
            if x is None:
                line.pop()
            elif isinstance(x, Element):
                yield x
                line.append(iter(x.holds))

    def fits(self, p: Pattern) -> bool:
        if (p.tag and self.tag != p.tag) or (p.id and self.at.get("id") != p.id) or (p.cls and p.cls not in self.classes) or (p.role and self.at.get("role") != p.role):
            return False
        up = self.up
        while p.inside and up is not None and not up.fits(p.inside):
            up = up.up
        return up is not None or not p.inside

    def first(self, p: Pattern) -> Element | None:
        return next((e for e in self.walk() if e.fits(p)), None)

    def text(self) -> str:
        """All text below with one space for each run of white space, and a space between elements."""
        out, line = [], [iter(self.holds)]
        while line:
            x = next(line[-1], None)
            if x is None:
                line.pop()
            elif isinstance(x, str):
                out.append(x)
            elif x.tag not in ("script", "style"):
                line.append(iter(x.holds))
        return _SPACE.sub(" ", " ".join(out)).strip()


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.now = Element("", {}, None)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        ends = _ENDS.get(tag, {"p"} if tag in _ENDS_P else set())
        while self.now.tag in ends and self.now.up is not None:
            self.now = self.now.up
        e = Element(tag, {k: v or "" for k, v in reversed(attrs)}, self.now)
        self.now.holds.append(e)
        if tag not in _VOID and e.depth < DEEPEST:  # what is deeper lies side by side
            self.now = e

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        e: Element | None = self.now
        while e is not None and e.tag != tag:
            e = e.up
        if e is not None and e.up is not None:
            self.now = e.up

    def handle_data(self, data: str) -> None:
        self.now.holds.append(data)


def parsed(page: str | None) -> Element:
    b = _Builder()
    b.feed(page or "")
    b.close()
    return b.root


def content(root: Element) -> Element:
    """The element with the content, without menus and the like inside it; the whole page if nothing else fits."""
    found = next((e for p in CONTENT if (e := root.first(p)) is not None), root)
    for e in [found, *found.walk()]:
        e.holds = [x for x in e.holds if isinstance(x, str) or not (x.tag in LEFT_OUT_TAGS or not LEFT_OUT_CLASSES.isdisjoint(x.classes))]
    return found


def title(root: Element, url: str) -> str:
    """The named title, else the first h1 without a trailing #, else <title>, else the last segment of the address."""
    named = root.first(NAMED_TITLE)
    if named is not None and named.text():
        return named.text()
    h1 = root.first(Pattern("h1"))
    if h1 is not None and h1.text():
        return h1.text().removesuffix("#").strip()
    t = root.first(Pattern("title"))
    return t.text() if t is not None and t.text() else url.rsplit("/", 1)[-1]


def headings(root: Element, most: int = 12) -> list[str]:
    """Texts of h1 to h4, each once, the first ``most`` of them."""
    found = (e.text().removesuffix("#").strip() for e in root.walk() if e.tag in ("h1", "h2", "h3", "h4"))
    return list(dict.fromkeys(t for t in found if t))[:most]


def links(root: Element) -> list[str]:
    """Targets of anchors in page order, each once."""
    return list(dict.fromkeys(e.at["href"].strip() for e in root.walk() if e.tag == "a" and e.at.get("href", "").strip()))


_BLOCKS = _ENDS_P | {"p", "li", "tr", "body", "html", "dt", "dd", "figcaption", "thead", "tbody", "tfoot", "caption", "details", "summary"}


def markdown(root: Element) -> str:
    """The element as Markdown: headings, paragraphs, lists, quotes, code, tables, links, images and emphasis."""
    blocks = [b for b in _blocks(root.holds) if b.strip()]
    return "\n\n".join(blocks) + "\n" if blocks else ""


def _blocks(holds: list[Element | str], depth: int = 0) -> list[str]:
    out: list[str] = []
    run: list[Element | str] = []

    def end() -> None:
        if run and (t := _inline(run).strip()):
            out.append(t)
        run.clear()

    for x in holds:
        if isinstance(x, str) or (x.tag not in _BLOCKS and not any(e.tag in _BLOCKS for e in x.walk())):
            run.append(x)
            continue
        end()
        if x.tag in ("script", "style"):
            continue
        if x.tag[:1] == "h" and x.tag[1:].isdigit():
            if t := _inline(x.holds).strip():
                out.append("#" * int(x.tag[1:]) + " " + t)
        elif x.tag == "pre":
            out.append("```\n" + _raw(x).strip("\n") + "\n```")
        elif x.tag == "hr":
            out.append("* * *")
        elif x.tag == "blockquote":
            inner = "\n\n".join(_blocks(x.holds, depth + 1))
            out.append("\n".join(("> " + line).rstrip() for line in inner.split("\n")) if inner else "")
        elif x.tag in ("ul", "ol"):
            items = [i for i in x.holds if isinstance(i, Element)]
            out.append("\n".join(_item(i, f"{k}. " if x.tag == "ol" else "* ", depth) for k, i in enumerate(items, 1)))
        elif x.tag == "table":
            rows = [[_inline(c.holds).strip().replace("|", "\\|") for c in r.holds if isinstance(c, Element) and c.tag in ("td", "th")] for r in x.walk() if r.tag == "tr"]
            rows = [r for r in rows if r]
            if rows:
                out.append("\n".join(["| " + " | ".join(r) + " |" for r in rows[:1]] + ["|" + " --- |" * len(rows[0])] + ["| " + " | ".join(r) + " |" for r in rows[1:]]))
        else:
            out += _blocks(x.holds, depth + 1)
    end()
    return out


def _item(x: Element, mark: str, depth: int) -> str:
    inner = "\n".join(_blocks(x.holds, depth + 1))
    return mark + inner.replace("\n", "\n" + " " * len(mark))


def _raw(x: Element) -> str:
    out = []
    for c in x.holds:
        out.append(c if isinstance(c, str) else "\n" if c.tag == "br" else _raw(c))
    return "".join(out)


def _inline(holds: list[Element | str]) -> str:
    out: list[str] = []
    for x in holds:
        if isinstance(x, str):
            out.append(_SPACE.sub(" ", x))
            continue
        inner = "" if x.tag in ("script", "style") or "headerlink" in x.classes else _inline(x.holds)
        bare = inner.strip()
        if x.tag == "br":
            out.append("  \n")
        elif x.tag == "img":
            out.append(f"![{x.at.get('alt', '')}]({x.at['src']})" if x.at.get("src") else "")
        elif x.tag == "a" and bare and x.at.get("href"):
            out.append(f"[{bare}]({x.at['href'].strip()})")
        elif x.tag in ("b", "strong") and bare:
            out.append(f"**{bare}**")
        elif x.tag in ("i", "em") and bare:
            out.append(f"_{bare}_")
        elif x.tag in ("code", "kbd", "samp", "tt") and bare:
            out.append(f"`{bare}`")
        else:
            out.append(inner)
    return re.sub(r"(?<=\n) +| {3,}(?=\S)", "", "".join(out))
