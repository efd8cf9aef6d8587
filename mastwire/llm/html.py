"""Main text of web pages by scoring the element tree.

Blocks of text give points for their length and commas to the elements around them, fewer the
farther out; links in an element cost it points. The element with the most points, and those
beside it that are like it, hold the article. Menus, adverts and the like never count: they are
known by their element, role, or the words of their class and id.
"""

from __future__ import annotations

import html as entities
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")

#: Fixed values of HTML: elements without an end, with raw text, that stand as blocks, that end an open one.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td "
    "tfoot th thead tr ul".split())
CLOSES_P = BLOCKS - frozenset("body caption dd dt head html legend li option tbody td tfoot th thead tr".split())
ENDS = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("td", "th", "tr"),
        "option": ("option",), "tbody": ("td", "th", "tr", "thead", "tbody"), "tfoot": ("td", "th", "tr", "tbody")}
SCOPES = {"li": ("ul", "ol", "menu"), "dd": ("dl",), "dt": ("dl",), "td": ("table",), "th": ("table",), "tr": ("table",),
          "tbody": ("table",), "tfoot": ("table",), "option": ("select",)}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements, roles and words of a class or id that mark what is not the article.
ASIDE = frozenset(
    "nav footer aside form button select option input label fieldset legend svg canvas object audio video map dialog menu head "
    "search datalist output meter progress math".split()) | RAW
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog toolbar".split())
NOTES = frozenset(
    "ad ads adv advert adverts advertisement advertisements adsense sponsor sponsored promo promotion banner sidebar nav navbar "
    "navigation menu breadcrumb breadcrumbs footer masthead toolbar notice notices cookie cookies consent gdpr popup modal overlay "
    "newsletter subscribe signup login share sharing social related recommended recommendations widget pagination pager copyright "
    "disclaimer alert toast".split())
REMARKS = frozenset("comment comments remark reply replies respond disqus commentlist responses discussion".split())
#: Elements outward from a block that get points from it.
REACH = 12
WHOLE = frozenset("html body main article".split())
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


@dataclass
class Element:
    tag: str
    parent: int
    out: bool = False  # it, or one around it, is not the article's
    score: float = 0.0
    size: int = 0  # signs of text inside, and those of them in links
    linked: int = 0
    links: int = 0
    depth: int = 0
    holds_article: bool = False


@dataclass
class Block:
    element: int
    text: str
    linked: int


@dataclass
class Page:
    elements: list[Element] = field(default_factory=lambda: [Element("", -1)])
    blocks: list[Block] = field(default_factory=list)


def _attributes(text: str) -> dict[str, str]:
    return {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(text)} if "=" in text or text.strip(" /") else {}


def _outside(tag: str, attributes: dict[str, str], in_article: bool) -> bool:
    if tag in ASIDE or tag == "header" and not in_article:
        return True
    if not attributes:
        return False
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or HIDDEN.search(attributes.get("style", "")):
        return tag not in ("html", "body")
    said = {w.lower() for k in ("class", "id") for w in WORD.findall(attributes.get(k, ""))}
    if said & REMARKS and tag not in ("html", "body", "main"):
        return True
    if tag in WHOLE:
        return False
    return attributes.get("role", "").lower() in ROLES or bool(said & NOTES) or "header" in said and not in_article and tag not in HEADINGS


def parsed(text: str) -> Page:
    """Elements with their parents, and blocks of text in page order, each with its element."""
    page = Page()
    elements, blocks = page.elements, page.blocks
    stack = [0]
    pieces: list[str] = []
    linked = 0
    links = articles = 0  # open elements of that kind

    def flush() -> None:
        nonlocal linked
        if pieces:
            said = " ".join("".join(pieces).split())
            pieces.clear()
            if said:
                at = next((i for i in reversed(stack) if elements[i].tag in BLOCKS), 0)
                blocks.append(Block(at, said, min(linked, len(said))))
        linked = 0

    def say(raw: str) -> None:
        nonlocal linked
        if raw and not elements[stack[-1]].out:
            raw = entities.unescape(raw) if "&" in raw else raw
            pieces.append(raw)
            if links:
                linked += len(raw)

    def close(depth: int) -> None:
        """Take elements from the stack until ``depth`` are left."""
        nonlocal links, articles
        for i in reversed(stack[depth:]):
            tag = elements[i].tag
            if tag in BLOCKS:
                flush()
            links -= tag == "a"
            articles -= tag in ("article", "main")
        del stack[depth:]

    def open_at(tags: tuple[str, ...], scope: tuple[str, ...] = ()) -> int:
        """Depth of the innermost open element of ``tags`` that no element of ``scope`` hides; 0 if none."""
        for depth in range(len(stack) - 1, 0, -1):
            tag = elements[stack[depth]].tag
            if tag in tags:
                return depth
            if tag in scope:
                return 0
        return 0

    at = 0
    while (m := TAG.search(text, at)) is not None:
        say(text[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        tag, ends = name.lower(), bool(m[1] or m[4])
        if ends:
            if depth := open_at((tag,), ("table",) if tag not in ("table", "article", "main", "body", "html", "div", "section") else ()):
                close(depth)
            elif tag in ("p", "br"):
                flush() if tag == "p" else say(" ")
            continue
        if tag == "br":
            say(" ")
            continue
        if tag in CLOSES_P and (depth := open_at(("p",), ("table", "article", "section", "div", "li", "td", "blockquote"))):
            close(depth)
        if tag in ENDS:
            while depth := open_at(ENDS[tag], SCOPES[tag]):
                close(depth)
        if tag == "a" and (depth := open_at(("a",), ("table",))):
            close(depth)
        if tag in BLOCKS:
            flush()
        if tag in VOID:
            continue
        attributes = _attributes(m[3] or m[6] or "")
        parent = elements[stack[-1]]
        elements.append(Element(tag, stack[-1], parent.out or _outside(tag, attributes, articles > 0), depth=parent.depth + 1))
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*>?", re.I).search(text, at)
            at = end.end() if end else len(text)
            continue
        if (m[3] or m[6] or "").endswith("/") and tag in ("svg", "path"):
            continue
        stack.append(len(elements) - 1)
        links += tag == "a"
        articles += tag in ("article", "main")
        parent.links += tag == "a"
    say(text[at:])
    close(1)
    flush()
    return page


def _weigh(page: Page) -> None:
    elements = page.elements
    for block in page.blocks:
        points = 0.0
        if elements[block.element].tag not in HEADINGS:
            points = 1 + block.text.count(",") + min(len(block.text) / 100, 3)
        own = elements[block.element]
        own.size += len(block.text)
        own.linked += block.linked
        at, level = block.element, 0
        while at >= 0 and level < REACH:
            e = elements[at]
            if level:
                e.score += points / (1 if level == 1 else 2 if level == 2 else 3 * level)
            elif e.tag != "p":
                e.score += points
            at, level = e.parent, level + 1
    for e in reversed(elements[1:]):
        elements[e.parent].links += e.links
        elements[e.parent].size += e.size
        elements[e.parent].linked += e.linked
        elements[e.parent].holds_article |= e.holds_article or e.tag in ("article", "main")
        e.score *= 1 - e.linked / e.size if e.size else 0


def _kept_elements(page: Page) -> set[int]:
    """The best container and the elements beside it that go with it."""
    elements = page.elements
    live = [i for i, e in enumerate(elements) if not e.out and e.size]
    containers = [i for i in live if not i or elements[i].tag in BLOCKS and elements[i].tag != "p" and elements[i].tag not in HEADINGS]
    best = max(containers, key=lambda i: (elements[i].score, -elements[i].depth, -i))
    # An article or main element around the best container holds all of the article; else climb
    # while what the parent adds is text and not links.
    around = []
    at = elements[best].parent
    while at > 0:
        around.append(at)
        at = elements[at].parent
    named = [i for i in (best, *around) if elements[i].tag in ("article", "main")]
    if named:
        best = next((i for i in named if elements[i].tag == "article"), named[0])
    else:
        for i in around:
            e, b = elements[i], elements[best]
            if e.tag in ("body", "html") or (e.linked - b.linked) * 4 > e.size - b.size:
                break
            best = i
    kept = {best}
    top = max(10.0, elements[best].score * 0.2)
    for i in live:
        e = elements[i]
        if i and i != best and e.parent == elements[best].parent:
            text = e.size - e.linked
            if e.score >= top or e.tag in HEADINGS and i < best or e.tag in ("article", "p", "section") and text > 80 and e.linked * 4 < e.size:
                kept.add(i)
    return kept


def main_text(html: str | None) -> str:
    """The article's blocks in page order, one a line; empty if there is none."""
    page = parsed(html or "")
    if not page.blocks:
        return ""
    _weigh(page)
    elements, kept = page.elements, _kept_elements(page)
    inside = [False] * len(elements)
    for i, e in enumerate(elements):
        menu = e.tag in ("ul", "ol", "dl") and e.links >= 3 and e.linked * 10 > e.size * 9
        inside[i] = not menu and (i in kept or i > 0 and inside[e.parent]) and not e.out
    return "\n".join(b.text for b in page.blocks if inside[b.element])


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars for every row of ``pages``.

    Null or empty html gives an empty text. Each page is worked on alone and whole, so repeated
    rows repeat their result; other columns are not read.
    """

    def run(batches):
        for batch in batches:
            found = [main_text(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array(list(map(len, found)), pa.int64())],
                names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(
        run, "page_id long, url string, text string, n_chars long")
