"""Main text of web pages by scoring the element tree.

Every text block gives points for its length and commas to its ancestors, less with distance;
a container's points are discounted by its share of link text.  The best container is kept
with those siblings that score or read like text.  A box that its name or tag marks as no part
of the article stays out unless it holds most of the page's prose.
"""

from __future__ import annotations

import html
import re

from pyspark.sql import DataFrame

from gleanframe.llm.rows import map_steps, picked, texts

# fixed values: elements by their role
RAW = frozenset("script style noscript template textarea title iframe xmp noembed noframes svg math object".split())
# of these, only elements of other languages can close themselves
FOREIGN = frozenset(("svg", "math"))
DROPPED = RAW | frozenset("head nav footer aside button select option label dialog menu canvas audio video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "html body main article section header div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th "
    "caption blockquote pre figure figcaption address details summary hr center".split()
) | DROPPED | {"form", "fieldset"}
# a start tag closes open elements of these kinds, up to the given boundary
CLOSES = {
    "li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# words of a class, id or role that mark what is not the article
UNLIKELY = frozenset(
    "ad ads advert adverts advertisement advertising adbox adsense banner sponsor sponsored promo promotion sidebar "
    "side rail menu nav navbar navigation topnav subnav breadcrumb breadcrumbs footer foot masthead header topbar comment "
    "comments commentlist disqus respond replies reply cookie cookies consent gdpr notice notices alert popup modal "
    "overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations "
    "pagination pager toolbar widget widgets skip search complementary contentinfo hidden paywall outbrain taboola".split()
)
# of these, words that a box carries first when it surely is no article: adverts; reader comments and notices
ADVERTS = frozenset("ad ads advert adverts advertisement advertising adbox adsense sponsor sponsored outbrain taboola".split())
CERTAIN = ADVERTS | frozenset("comment comments commentlist disqus respond replies reply notice notices cookie cookies consent gdpr".split())
# a box that is named so and nothing else holds links to other pages
MENUS = frozenset("menu mainmenu nav navbar navigation topnav subnav breadcrumb breadcrumbs".split())
# words after which a name says what a page is like, not what a box holds
STATES = frozenset("open closed enabled disabled on off none free".split())
# what a head may hold; any other tag begins the body
HEAD_PARTS = frozenset("title meta link base style script noscript template basefont bgsound".split())
# elements that mostly hold controls, but may be wrapped around a page
FORMS = frozenset(("form", "fieldset"))
HOLDERS = frozenset("html body article main".split())
TAG_POINTS = {"article": 10, "main": 10, "section": 3, "div": 3, "pre": 3, "td": 3, "blockquote": 3, "ul": -3, "ol": -3, "form": -3}

# characters from which a block gives points, length points at most, and generations that get some
BLOCK_CHARS, LENGTH_POINTS, GENERATIONS = 25, 3.0, 5
# a sibling stays from this share of the best score, or these points
SIBLING_SHARE, SIBLING_POINTS = 0.2, 10.0
LINK_SHARE = 0.5
# a marked box counts when the text outside marked boxes is less than this share of its prose,
# or than this share if it holds the page's first heading or its main element
BOX_SHARE, WRAPPER_SHARE = 0.1, 1.0

_TAG = re.compile(
    r"""<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|$)""",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORD = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def attributes_of(source: str) -> dict[str, str]:
    """Names, lower-cased, and values of a start tag's attributes; the first of a name counts."""
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(source):
        out.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return out


def _hidden(attributes: dict[str, str]) -> bool:
    style = "".join(attributes.get("style", "").lower().split())
    return (
        "hidden" in attributes or attributes.get("aria-hidden", "").strip().lower() == "true"
        or "display:none" in style or "visibility:hidden" in style
    )


def _words(name: str) -> list[str]:
    return _WORD.findall(_CAMEL.sub(" ", name).lower())


def _meant(tag: str, attributes: dict[str, str], within: bool) -> tuple[bool, bool]:
    """(marked, certain): whether class, role or id name what is not the article, and whether beyond doubt.

    Headings, paragraphs and inline elements are only taken for adverts, by their class: the rest
    of their names describes how they look, and their ids come from the text.  An id counts when
    all its words do, and inside an article (``within``) only when they mean comments or adverts.
    """
    names = [_words(n) for key in ("class", "role") for n in attributes.get(key, "").split()]
    if tag not in BLOCKS or tag in HEADINGS or tag == "p":
        advert = any(w and w[0] in ADVERTS and STATES.isdisjoint(w) for w in names)
        return advert, advert
    own = _words(attributes.get("id", ""))
    if own and all(w in (CERTAIN if within else UNLIKELY) for w in own):
        names.append(own)
    marked = any(not UNLIKELY.isdisjoint(w) for w in names)
    certain = any(w and (w[0] in CERTAIN and STATES.isdisjoint(w) or len(w) == 1 and w[0] in MENUS) for w in names)
    return marked, certain


class Page:
    """Elements in page order, each with its parent, and text blocks with the element they lie in."""

    def __init__(self, source: str):
        self.tags, self.parents, self.dropped = ["#root"], [-1], [False]
        # elements that their name or tag marks, unless hidden or dropped
        self.marked: list[int] = []
        # the first h1, if it stands in a marked element that is dropped
        self.headed = -1
        # element, pieces of text, characters of link text
        self.blocks: list[tuple[int, str, int]] = []
        self._stack = [0]
        self._open: dict[str, int] = {}
        self._pieces: list[tuple[str, bool]] = []
        self._parse(source)

    def _block(self) -> int:
        """The nearest open block element."""
        return next((n for n in reversed(self._stack) if self.tags[n] in BLOCKS), 0)

    def _flush(self) -> None:
        if self._pieces:
            text = " ".join("".join(p for p, _ in self._pieces).split())
            if text:
                links = sum(len(" ".join(p.split())) for p, link in self._pieces if link)
                self.blocks.append((self._block(), text, min(links, len(text))))
            self._pieces = []

    def _text(self, raw: str) -> None:
        if self._open.get("head") and self.tags[self._stack[-1]] == "head" and not raw.isspace() and raw:
            # text begins the body too
            self._close({"head"}, {"html"})
        if raw and not self.dropped[self._stack[-1]]:
            self._pieces.append((html.unescape(raw) if "&" in raw else raw, self._open.get("a", 0) > 0))

    def _push(self, tag: str, attributes: str) -> None:
        inside = self._stack[-1]
        named = drop = tag in DROPPED
        if tag not in HOLDERS and attributes and not attributes.isspace():
            found = attributes_of(attributes)
            named, certain = _meant(tag, found, bool(self._open.get("article") or self._open.get("main")))
            drop = drop or certain or _hidden(found)
        if tag == "header" and not (self._open.get("article") or self._open.get("main")):
            drop = True
        self.tags.append(tag)
        self.parents.append(inside)
        drop = drop or self.dropped[inside]
        if not drop and (tag in FORMS or named):
            self.marked.append(len(self.tags) - 1)
        self.dropped.append(drop)
        self._stack.append(len(self.tags) - 1)
        self._open[tag] = self._open.get(tag, 0) + 1

    def _pop_to(self, depth: int) -> None:
        while len(self._stack) > depth:
            tag = self.tags[self._stack[-1]]
            if tag in BLOCKS:
                self._flush()
            self._open[tag] -= 1
            self._stack.pop()

    def _close(self, kinds: frozenset | set, bounds: set) -> None:
        for depth in range(len(self._stack) - 1, 0, -1):
            tag = self.tags[self._stack[depth]]
            if tag in kinds:
                self._pop_to(depth)
            elif tag in bounds:
                break

    def _parse(self, source: str) -> None:
        at = 0
        while m := _TAG.search(source, at):
            self._text(source[at:m.start()])
            at = m.end()
            ending, name, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
            if not name:
                continue
            tag = name.lower()
            if ending:
                if not self._open.get(tag):
                    continue
                depth = next(i for i in range(len(self._stack) - 1, 0, -1) if self.tags[self._stack[i]] == tag)
                # an inline end tag does not close blocks
                if tag in BLOCKS or not any(self.tags[n] in BLOCKS for n in self._stack[depth:]):
                    self._pop_to(depth)
                continue
            if self._open.get("head") and tag not in HEAD_PARTS and tag != "head":
                self._close({"head"}, {"html"})
            if tag == "br":
                self._text(" ")
            if tag in BLOCKS:
                self._flush()
                if self._open.get("p"):
                    self._close({"p"}, {"table", "td", "button"})
            if tag in CLOSES:
                self._close(*CLOSES[tag])
            if tag in VOID or attributes.endswith("/") and (tag not in BLOCKS or tag in FOREIGN):
                continue
            if tag in RAW:
                end = re.compile("</" + re.escape(tag) + r"(?=[\s/>]|$)[^>]*>?", re.IGNORECASE).search(source, at)
                at = end.end() if end else len(source)
                continue
            self._push(tag, attributes)
        self._text(source[at:])
        self._flush()
        self._pop_to(1)
        if self.marked:
            self._drop_boxes()

    def _drop_boxes(self) -> None:
        """Drops the marked elements that do not hold most of the page's prose, with all inside."""
        n, marked = len(self.tags), set(self.marked)
        # nearest marked element of each element, itself included
        box = [-1] * n
        for e in range(1, n):
            box[e] = e if e in marked else box[self.parents[e]]
        self.headed = next((e for e in range(n) if self.tags[e] == "h1" and not self.dropped[e]), -1)
        evident = [(e == self.headed or self.tags[e] == "main") and not self.dropped[e] for e in range(n)]
        # prose with all inside, text of an element's own boxless parts, and text outside of what may be dropped
        prose, direct, outside = [0] * n, [0] * n, 0
        for element, text, link in self.blocks:
            if box[element] < 0:
                outside += len(text) - link
            else:
                direct[box[element]] += len(text) - link
            if len(text) >= BLOCK_CHARS and self.tags[element] not in HEADINGS:
                prose[element] += len(text) - link
        for e in range(n - 1, 0, -1):
            prose[self.parents[e]] += prose[e]
            evident[self.parents[e]] |= evident[e]
        counted = {-1}
        # the fullest first, so what is around before what is inside
        for e in sorted(self.marked, key=lambda e: (-prose[e], e)):
            if box[self.parents[e]] in counted and outside < (WRAPPER_SHARE if evident[e] else BOX_SHARE) * prose[e]:
                counted.add(e)
                outside += direct[e]
        for e in range(1, n):
            self.dropped[e] = self.dropped[e] or self.dropped[self.parents[e]] or e in marked and e not in counted
        if self.headed >= 0 and not self.dropped[self.headed]:
            self.headed = -1
        self.blocks = [b for b in self.blocks if not self.dropped[b[0]] or b[0] == self.headed]

    def main_blocks(self) -> list[str]:
        """Texts of the kept blocks in page order."""
        n = len(self.tags)
        points, size, links = [0.0] * n, [0] * n, [0] * n
        scored = [False] * n
        for element, text, link in self.blocks:
            size[element] += len(text)
            links[element] += link
            if len(text) < BLOCK_CHARS or self.tags[element] in HEADINGS:
                continue
            value = 1 + text.count(",") + min(len(text) / 100, LENGTH_POINTS)
            value *= 1 - link / len(text)
            # a paragraph passes its points up; a plain container with text of its own takes part
            up, share = element if self.tags[element] in TAG_POINTS else self.parents[element], 1.0
            for generation in range(GENERATIONS):
                if up <= 0:
                    break
                points[up] += value * share
                scored[up] = True
                up, share = self.parents[up], 0.5 / (generation + 1)
        for e in range(n - 1, 0, -1):
            size[self.parents[e]] += size[e]
            links[self.parents[e]] += links[e]
        total = [
            (points[e] + TAG_POINTS.get(self.tags[e], 0)) * (1 - links[e] / size[e]) if scored[e] and size[e] else 0.0
            for e in range(n)
        ]
        best = max(range(n), key=lambda e: (total[e], -e))
        keep = set()
        if total[best] <= 0:
            # nothing scored: short pages are what their article, else their body, holds
            holders = [e for e in range(n) if self.tags[e] in ("article", "main") and size[e]]
            keep = {max(holders, key=lambda e: size[e])} if holders else {0}
        else:
            up = best
            while up > 0:
                if self.tags[up] in ("article", "main"):
                    best = up
                up = self.parents[up]
            keep.add(best)
            around, floor = self.parents[best], max(SIBLING_POINTS, SIBLING_SHARE * total[best])
            texts_of: dict[int, str] = {}
            for element, text, _ in self.blocks:
                if self.parents[element] == around:
                    texts_of[element] = text
            for e in range(1, n):
                if self.parents[e] != around or e == best or self.dropped[e] or not size[e]:
                    continue
                density, text = links[e] / size[e], texts_of.get(e, "")
                prose = self.tags[e] in ("p", "blockquote", "pre") and density < 0.25 and (
                    size[e] > 80 or density == 0 and text.endswith((".", "!", "?", "…"))
                )
                if total[e] >= floor or prose or self.tags[e] == "h1":
                    keep.add(e)
        inside = [False] * n
        if self.headed >= 0 and best > 0:
            # a title often stands in a box named for it, beside the text or within
            up = self.headed
            while up > 0 and self.dropped[up]:
                up = self.parents[up]
            above = up
            while above > 0 and above not in keep:
                above = self.parents[above]
            if above in keep or up == self.parents[best]:
                keep.add(self.headed)
        for e in range(n):
            # lists and boxes of links within the article stay out
            boxed = self.tags[e] in ("ul", "ol", "div", "section", "table") and links[e] > LINK_SHARE * size[e]
            inside[e] = e in keep or e > 0 and inside[self.parents[e]] and not boxed
        return [text for element, text, _ in self.blocks if inside[element]]


def main_text(source: str) -> str:
    """The article of a page, its blocks joined by line ends; empty for an empty page."""
    return "\n".join(Page(source).main_blocks()) if source else ""


def extract_text(df: DataFrame, *, key: str = "page_id", html: str = "html", carry: tuple[str, ...] = ("url",)) -> DataFrame:
    """(key, carry…, text, n_chars), one row per page; ``n_chars`` counts code points.

    Null and empty pages have the empty text.  Nothing is cut, however long or broken the page;
    repeated pages give equal rows and an empty table an empty one.
    """
    def run(columns):
        found = [main_text(t) for t in texts(columns[html])]
        return [columns[key], *[columns[c] for c in carry], found, [len(t) for t in found]]

    def ddl(name: str) -> str:
        return f"`{name}` {df.schema[name].dataType.simpleString()}"

    schema = ", ".join([*map(ddl, [key, *carry]), "text string, n_chars bigint"])
    return map_steps(picked(df, list(dict.fromkeys([key, html, *carry]))), run, schema)
