"""Main-text extraction from HTML by tag-path ratios.

Text nodes are grouped by their root-to-leaf tag path. For each path the characters, the
punctuation marks and the link characters per node are aggregated, fused into one ratio,
smoothed over the nodes in page order, and thresholded against the mean by characters and priors: the
nodes of the paths above it are the content. Two priors weigh in the ratio: being inside an
article or main element, and a class or id that names a notice, an advert, a comment section
or the like. Elements whose tag or role says that they are no article (menus, forms, scripts,
footers, asides) are no candidates at all, wherever they stand: a byline in an article's footer or a quote in
an aside goes with it.

A class or id only counts in full if all words of one token name such a part (``cookie-banner``, ``comments``).
One word among others (``social-history``, ``share-price``), or an id inside an article unless it names reader comments (ids are anchors there, as in
a section on cookies), is a weak hint: inside an article the part goes only if its own ratio agrees,
that is, if it is mostly links or has no punctuation at all and is no table or heading; elsewhere it weighs less.
A list of links only, however long, stays inside an article (references); elsewhere it stays if there is punctuation in it.

The text is what lies in the innermost element around all content nodes (or the article or
main element that is in): its content nodes and what stands between them; before the first
and behind the last one only paragraphs, items, cells and headings, no bare text. A part with a telling class or
id stays out unless its nodes are content, and such a word doesn't count on an element around
the articles or, on pages without, around most of the content.

Defined cases: null or empty html has an empty text; tags and attributes are read as browsers
do (a slash closes nothing, a quote counts only behind an equals sign, what is open at the end
of the page hides the rest); unclosed, misnested and unknown tags are tolerated (a block closes
an open paragraph, an end tag closes what it encloses); time is linear in the page, whatever
the nesting; equal and null ids are rows like any other; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import slices

# Element names by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
RAW = frozenset("script style textarea title noscript iframe template svg math canvas object audio video noframes xmp".split())
APART = frozenset("nav footer aside form head menu dialog button select option label search input".split()) | RAW
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
#: Words of class and id values that mark an element as no article text.
HINTS = frozenset(
    "ad ads adsense adv advert adverts advertisement advertising banner breadcrumb breadcrumbs byline-links comment comments commentlist consent cookie cookies copyright disqus"
    " footer gdpr login masthead menu modal nav navbar navigation newsletter notice notification outbrain overlay pager pagination popup promo promoted promotion recommended"
    " related share sharing shares sidebar signup skip social sponsor sponsored subscribe subscription taboola teaser toolbar topbar widget".split()
)
#: Words that make the hint after them a state of the layout, and words of ids that say nothing beside a hint.
STATES, NEUTRAL = frozenset("has no not with without".split()), frozenset("area bar block box container content list section wrap wrapper".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that an open element of the key closes at their start.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
BARRIERS = frozenset("table ul ol dl td th article section div body html main aside blockquote".split())

_OPEN = re.compile(r"<(?:!--(?P<comment>-?>|.*?(?:--!?>|\Z))|(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*)|[!?/][^>]*(?:>|\Z))", re.S)
#: One step inside a tag: blanks and slashes, its end, or an attribute.
_STEP = re.compile(r"""[\s/]+|(?P<close>>)|(?P<name>=?[^\s/>=]*)(?:\s*=\s*(?:"(?P<double>[^"]*)(?:"|(?P<cut>\Z))|'(?P<single>[^']*)(?:'|(?P<cut2>\Z))|(?P<plain>[^\s>"'][^\s>]*))?)?""", re.S)
_PUNCTUATION = re.compile(r"[.,;:!?…。，、،]")
_PART = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z]+(?![a-z])")

SIGMA, RADIUS = 0.5, 2
#: Share of the mean ratio (by characters) that a path needs; weight of an article, of a telling class or id, and of one that tells in part.
THRESHOLD, ARTICLE, HINT, PARTLY = 0.3, 3.0, 0.1, 0.5
#: How much a class or id says.
NONE, WEAK, STRONG = 0, 1, 2
#: Words by which an id inside an article names its reader comments.
REPLIES = frozenset("comment comments commentlist disqus".split())
#: Share with which a paragraph, item or cell with punctuation next to content joins it (a heading always does).
NEXT = 0.04
#: Shares of the content with which a hinted element is no such part: on pages without an article, and inside a main element.
SHARE, MOST = 0.7, 0.5
#: Elements that are text on their own, wherever they stand.
TEXTUAL = HEADINGS | frozenset("p li dt dd pre blockquote td th caption figcaption summary".split())


class Element:
    __slots__ = ("apart", "hinted", "inner", "linked", "listed", "name", "number", "parent", "path", "textual")

    def __init__(self, name: str, number: int, parent: Element | None, path: int, apart: bool = False, hinted: int = NONE) -> None:
        self.name, self.number, self.parent, self.path = name, number, parent, path
        self.hinted, self.apart = hinted, apart or (parent is not None and parent.apart)
        self.inner = name in ("article", "main") or (parent is not None and parent.inner)
        self.linked = name == "a" or (parent is not None and parent.linked)
        self.listed = number if name in ("ul", "ol") else parent.listed if parent is not None else None
        self.textual = name in TEXTUAL or (name not in BLOCK and parent is not None and parent.textual)


class Block:
    __slots__ = ("element", "pieces")

    def __init__(self, element: Element) -> None:
        self.element, self.pieces = element, []


def _attributes(html: str, at: int) -> tuple[list[tuple[str, str]], int]:
    """The attributes of the tag whose name ends at ``at``, and where the tag ends; past the page if it doesn't."""
    found: list[tuple[str, str]] = []
    while at < len(html):
        m = _STEP.match(html, at)
        if m["close"]:
            return found, m.end()
        if m["cut"] is not None or m["cut2"] is not None:
            break
        if m["name"]:
            found.append((m["name"].lower(), m["double"] or m["single"] or m["plain"] or ""))
        at = max(m.end(), at + 1)
    return found, len(html) + 1


def _role(name: str, attributes: list[tuple[str, str]], inner: bool) -> tuple[bool, int, str]:
    """Whether an element holds no article text, how much its class or id hints so, and the name that its path shows."""
    if name in APART or name == "header" and not inner:
        return True, NONE, name
    words: list[str] = []
    hinted = NONE
    for kind, value in attributes:
        if kind == "hidden" or kind == "aria-hidden" and value.lower() == "true":
            return True, NONE, name
        if kind == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True, NONE, name
        if kind == "role" and value.lower() in ROLES:
            return True, NONE, name
        if kind in ("class", "id"):
            for token in value.split():
                parts = [w.lower() for w in _PART.findall(token)]
                words += parts
                hits = [w for a, w in zip(["", *parts], parts, strict=False) if (w in HINTS or w == "header" and not inner) and a not in STATES]
                whole = all(w in HINTS or w in NEUTRAL or w.isdigit() for w in parts)
                if not hits or kind == "id" and (name in HEADINGS or inner and not whole) or name in HEADINGS and inner and not whole:
                    continue
                anchor = kind == "id" and inner and not REPLIES.intersection(parts)
                hinted = max(hinted, STRONG if whole and not anchor else WEAK)
    plain = name in ("html", "body", "article", "main")
    return False, NONE if plain else hinted, f"{name}.{words[0]}" if words and not plain else name


def parse(html: str) -> tuple[list[Element], list[Block]]:
    """All elements in page order, and the blocks of text, each with the innermost element that it starts in."""
    root = Element("", 0, None, 0)
    elements, stack, open_ = [root], [root], Counter()
    paths: dict[tuple[int, str], int] = {}
    blocks: list[Block] = []
    block: Block | None = None
    at = 0

    def text(piece: str) -> None:
        nonlocal block
        if not piece:
            return
        if block is None:
            if piece.isspace():
                return
            block = Block(stack[-1])
            blocks.append(block)
        block.pieces.append((unescape(piece), stack[-1]))

    def shut(first: int) -> None:
        """Closes the open elements from the ``first``-th on."""
        nonlocal block
        for e in stack[first:]:
            open_[e.name] -= 1
            if e.name in BLOCK:
                block = None
        del stack[first:]

    def close(names: tuple[str, ...], opened: str) -> None:
        """Closes the innermost open element of ``names`` unless a container lies between."""
        if not any(open_[n] for n in names):
            return
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].name in names:
                return shut(i)
            if stack[i].name in BARRIERS and not (opened in CLOSES and stack[i].name in CLOSES[opened]):
                return None
        return None

    while at < len(html):
        m = _OPEN.search(html, at)
        if not m:
            text(html[at:])
            break
        text(html[at : m.start()])
        at = m.end()
        if not m["name"]:
            continue
        attributes, at = _attributes(html, at)
        if at > len(html):  # a tag that doesn't end is none
            break
        name = m["name"].lower()
        if m["end"]:
            if open_[name]:
                shut(next(i for i in range(len(stack) - 1, 0, -1) if stack[i].name == name))
            continue
        if name == "br":
            text(" ")
            continue
        if name in BLOCK:
            block = None
            close(("p",), name)
        if name in CLOSES:
            close(CLOSES[name], name)
        if name in VOID:
            continue
        if name in RAW:
            if not (name in ("svg", "math") and html[at - 2] == "/"):
                end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(html, at)
                at = end.end() if end else len(html)
            continue
        apart, hinted, key = _role(name, attributes, stack[-1].inner)
        path = paths.setdefault((stack[-1].path, key), len(paths) + 1)
        own = Element(name, len(elements), stack[-1], path, apart, hinted)
        elements.append(own)
        stack.append(own)
        open_[name] += 1
    return elements, blocks


def _up(elements: list[Element], counted: Iterable[tuple[Element, int]]) -> list[int]:
    """For each element the sum of what is counted in it (an element stands behind its parent)."""
    sums = [0] * len(elements)
    for e, n in counted:
        sums[e.number] += n
    for e in reversed(elements):
        if e.parent is not None:
            sums[e.parent.number] += sums[e.number]
    return sums


def _down(elements: list[Element], own: Iterable[int]) -> list[bool]:
    """Whether each element is one of ``own`` or in one."""
    flags = [False] * len(elements)
    for k in own:
        flags[k] = True
    for e in elements:
        if e.parent is not None and flags[e.parent.number]:
            flags[e.number] = True
    return flags


def fused_ratios(nodes: list[tuple[int, int, int, int, float]]) -> list[float]:
    """For each text node (path, characters, punctuation, link characters, prior) the fused and smoothed ratio of its path."""
    totals: dict[int, list[float]] = {}
    for path, chars, marks, links, prior in nodes:
        total = totals.setdefault(path, [0, 0, 0, 0, 0.0])
        for k, x in enumerate((chars, marks, links, 1, prior)):
            total[k] += x
    fused = {p: (c / n) * math.log1p(1 + m / n) * (1 - min(1.0, k / c) if c else 0.0) ** 2 for p, (c, m, k, n, _) in totals.items()}
    kernel = [math.exp(-(d * d) / (2 * SIGMA * SIGMA)) for d in range(-RADIUS, RADIUS + 1)]
    raw = [fused[p] for p, *_ in nodes]
    sums: dict[int, list[float]] = {}
    for i, (path, *_) in enumerate(nodes):
        near = [(kernel[j - i + RADIUS], raw[j]) for j in range(max(0, i - RADIUS), min(len(raw), i + RADIUS + 1))]
        held = sums.setdefault(path, [0.0, 0])
        held[0] += sum(k * x for k, x in near) / sum(k for k, _ in near)
        held[1] += 1
    weighed = {p: held[0] / held[1] * totals[p][4] / totals[p][3] for p, held in sums.items()}  # priors last, so that they don't spread
    return [weighed[p] for p, *_ in nodes]


def extract_text(html: str | None) -> str:
    """The article's blocks, white space inside each made one space, joined by newlines."""
    elements, found = parse(html or "")
    blocks, texts, linked = [], [], []
    for b in found:
        t = " ".join("".join(p for p, _ in b.pieces).split())
        if t and not b.element.apart:
            blocks.append(b)
            texts.append(t)
            linked.append(sum(len(p) for p, e in b.pieces if e.linked))
    lists = _link_lists(blocks, texts, linked)
    keep = [i for i in range(len(blocks)) if i not in lists]
    blocks, texts, linked = ([x[i] for i in keep] for x in (blocks, texts, linked))
    if not blocks:
        return ""
    marked = _marked(elements, blocks, texts, linked, _content(blocks, texts, linked, [NONE] * len(elements))[0])
    said = [marked[b.element.number] == STRONG for b in blocks]
    if any(b.element.inner and not x for b, x in zip(blocks, said, strict=True)):  # there is an article besides the parts that say they are none
        blocks, texts, linked = ([x for x, out in zip(xs, said, strict=True) if not out] for xs in (blocks, texts, linked))
    content, near = _content(blocks, texts, linked, marked)
    usable = [i for i, b in enumerate(blocks) if not marked[b.element.number] or i in content]
    core = _with_next(usable, content, near, blocks)
    around = _up(elements, [(blocks[i].element, 1) for i in core])
    home = next(e for e in reversed(elements) if around[e.number] == len(core))
    outer = home
    while outer is not None and outer.name not in ("article", "main"):
        outer = outer.parent
    inside = _down(elements, [(outer or home).number])
    first, last = min(core), max(core)
    kept = [i for i in usable if inside[blocks[i].element.number] and (outer or first <= i <= last or blocks[i].element.textual)]
    return "\n".join(texts[i] for i in kept)


def _content(blocks: list[Block], texts: list[str], linked: list[int], marked: list[int]) -> tuple[set[int], set[int]]:
    """The blocks with a node whose path's ratio reaches the threshold (all if none does), and those that reach the lower one."""
    nodes = []
    for b in blocks:
        for piece, e in b.pieces:
            chars = len(piece.strip())
            prior = (ARTICLE if e.inner else 1.0) * (1.0, PARTLY, HINT)[marked[e.number]]
            nodes.append((e.path, chars, len(_PUNCTUATION.findall(piece)), chars if e.linked else 0, prior))
    ratios = fused_ratios(nodes)
    mean = sum(r * n[1] * n[4] for r, n in zip(ratios, nodes, strict=True)) / (sum(n[1] * n[4] for n in nodes) or 1)
    at, chosen, near = 0, set(), set()
    for i, b in enumerate(blocks):
        score = max(ratios[at : at + len(b.pieces)])
        at += len(b.pieces)
        if linked[i] <= 0.5 * len(texts[i]):
            if score >= THRESHOLD * mean:
                chosen.add(i)
            if score >= NEXT * mean and b.element.textual and _PUNCTUATION.search(texts[i]):
                near.add(i)
    return chosen or set(range(len(blocks))), near


def _with_next(kept: list[int], content: set[int], near: set[int], blocks: list[Block]) -> set[int]:
    """The content blocks, and next to them headings and what is nearly content."""
    chosen = set(content)
    for order in (kept, kept[::-1]):
        for a, b in zip(order, order[1:], strict=False):
            if a in chosen and (b in near or blocks[b].element.name in HEADINGS):
                chosen.add(b)
    return chosen


def _marked(elements: list[Element], blocks: list[Block], texts: list[str], linked: list[int], content: set[int]) -> list[int]:
    """How much says for each element that it is in a part that is no article.

    A telling word doesn't count on an element that holds all articles or, where there is none, ``SHARE`` of the content.
    A weak hint inside an article counts in full if the part's own text agrees, else not at all.
    """
    hinted = [e for e in elements if e.hinted]
    if not hinted:
        return [NONE] * len(elements)
    votes = _up(elements, [(blocks[i].element, len(texts[i])) for i in content])
    total = votes[0]
    used = _up(elements, [(b.element, 1) for b in blocks])
    real = [e for e in elements if e.name in ("article", "main") and used[e.number]]
    real = [e for e in real if e.name == "article"] or real
    within = _down(elements, [e.number for e in hinted if e.hinted == STRONG])
    if not all(within[e.number] for e in real):  # articles in such a part (comments, related ones) are not the article
        real = [e for e in real if not within[e.number]]
    held = _up(elements, [(e, 1) for e in real])
    main = _down(elements, [e.number for e in elements if e.name == "main"])
    chars = _up(elements, [(b.element, len(t)) for b, t in zip(blocks, texts, strict=True)])
    links = _up(elements, [(b.element, k) for b, k in zip(blocks, linked, strict=True)])
    marks = _up(elements, [(b.element, len(_PUNCTUATION.findall(t)) + (b.element.name in ("td", "th"))) for b, t in zip(blocks, texts, strict=True)])

    def level(e: Element) -> int:
        if real and held[e.number] == len(real) and (not main[e.number] or votes[e.number] >= MOST * total):
            return NONE
        if not real and total > 0 and votes[e.number] >= SHARE * total:
            return NONE
        if e.hinted == WEAK and e.parent is not None and e.parent.inner:
            return STRONG if links[e.number] > 0.5 * chars[e.number] or not marks[e.number] else NONE
        return e.hinted

    levels = [(e.number, level(e)) for e in hinted]
    strong, weak = _down(elements, [k for k, n in levels if n == STRONG]), _down(elements, [k for k, n in levels if n == WEAK])
    return [STRONG if x else WEAK if y else NONE for x, y in zip(strong, weak, strict=True)]


def _link_lists(blocks: list[Block], texts: list[str], linked: list[int]) -> set[int]:
    """The items of lists outside articles that hold links only and no punctuation: their ratio is zero even if links counted as text."""
    lists: dict[int, list[int]] = {}
    for i, b in enumerate(blocks):
        if b.element.listed is not None and not b.element.inner:
            lists.setdefault(b.element.listed, []).append(i)
    return {
        i
        for items in lists.values()
        if sum(linked[i] for i in items) >= 0.9 * sum(len(texts[i]) for i in items) and not any(_PUNCTUATION.search(texts[i]) for i in items)
        for i in items
    }


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "html"):
        texts = [extract_text(h) for h in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract_pages(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) -> page_id, url, text, n_chars."""
    narrow = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return narrow.mapInArrow(_scan, "page_id long, url string, text string, n_chars long")
