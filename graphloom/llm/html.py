"""Main text of web pages by line-block distribution.

Markup is stripped to one line per block of the page, and the lines are those of the element around them that parts the
page (a division, section, menu, article, ...).  The distribution of an element is the sum of text lengths over sliding
windows of its own lines; text of links does not count, and an element within it is an empty line, or a whole window of
them if it is a menu, header or footer.  The distribution dives where a window holds nothing.  Between two dives lies a
stretch; it is main text if it surges to three tenths of the highest surge of the page, and all its blocks are,
short ones and links too, as well as what lies in an element between them.

Two things come before that.  In an element marked as main content, which hides what is outside it, a surge is one
character: there only the dives decide, and only lists of links are left out.  And menus, headers, footers, asides, forms and
elements whose class, id or role says the like are left out by name, as the contract does with what lies beside an article
however long it is.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from html import unescape
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import texts_of
from .words import refuse, slices

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
RAW = {"script", "style", "textarea", "title", "noscript", "template", "xmp", "iframe", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "ruby", "rt", "rp", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
#: Elements that hold no prose.
HIDDEN = {"head", "select", "option", "svg", "canvas", "object", "audio", "video", "map", "button", "dialog"}
#: Elements beside the main text.
NEVER = {"nav", "header", "footer", "aside", "form", "menu"}
#: Words in class, id or role that tell that an element is beside the main text, and words that tell nothing.
BESIDE = {"ad", "ads", "advert", "adverts", "advertisement", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "complementary", "contentinfo", "cookie", "cookies", "copyright", "disqus", "footer", "header", "hidden", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notification", "pager", "pagination", "popup", "promo", "recommended", "related", "reply", "replies", "respond", "rss", "search", "share", "sharing", "sidebar", "sidebars", "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget"}
PLAIN = {"area", "bar", "block", "bottom", "box", "container", "global", "inner", "item", "items", "left", "link", "links", "list", "outer", "page", "right", "section", "site", "top", "wrap", "wrapper"}
TALK = {"comment", "comments", "reply", "replies"}
MARKED = {"article", "main"}
MARKS = {"articlebody", "article-body", "main", "main-content"}
WORDS = re.compile(r"[a-z]+")

#: HTML's implied end tags: a start tag ends the outermost of the open elements named first, as far out as the nearest of those named second.
SCOPE = {"applet", "button", "caption", "marquee", "object", "table", "td", "template", "th"}
BLOCKS = {"address", "article", "aside", "blockquote", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "li", "listing", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table", "ul"}
PARTS = {"tbody", "thead", "tfoot"}
ROWS = {"caption", "colgroup", "tr"}
IMPLIED = {name: [({"p"}, SCOPE)] for name in BLOCKS}
IMPLIED["li"] = [({"li"}, (BLOCKS | SCOPE) - {"address", "div", "p", "li"}), *IMPLIED["li"]]
IMPLIED |= {name: [({"dt", "dd"}, (BLOCKS | SCOPE) - {"address", "div", "p", "dt", "dd"}), *IMPLIED[name]] for name in ("dt", "dd")}
IMPLIED |= {name: [({"td", "th"} | ROWS - {"tr"}, {"table"})] for name in ("td", "th")}
IMPLIED |= {"tr": [({"td", "th"} | ROWS, {"table"})]} | {name: [({"td", "th"} | ROWS | PARTS, {"table"})] for name in (*PARTS, "caption", "colgroup")}
IMPLIED |= {"option": [({"option"}, {"select", "datalist"})], "optgroup": [({"option", "optgroup"}, {"select"})]}
TABLE = PARTS | ROWS | {"table", "td", "th"}
IN_HEAD = RAW | {"base", "basefont", "bgsound", "link", "meta", "head"}

#: Elements with lines of their own; those named second are a line like any other if they hold just one.
PARTING = {"article", "aside", "body", "footer", "form", "header", "main", "menu", "nav"}
LEAVES = {"center", "div", "section", "td", "th"}
#: Elements that leave a whole window of empty lines.
REGIONS = {"nav", "header", "footer"}

WINDOW = 3
#: Part of the page's highest surge that a stretch must reach.
SURGE = 0.3


class Line(NamedTuple):
    """A block's text, its characters outside links, and whether it is an item of a list."""

    text: str
    weight: int
    item: bool


class Box:
    """An element with lines of its own, in page order with the elements in it."""

    __slots__ = ("beside", "items", "marked", "name")

    def __init__(self, name: str, marked: bool, beside: bool):
        self.name, self.marked, self.beside = name, marked, beside
        self.items: list[Line | Box] = []


def tree(page: str, everything: bool = False) -> Box:
    """The page's lines by the elements that hold them; ``everything``: with titles and what stands for scripts."""
    root = Box("", False, False)
    boxes = [(-1, root)]  # with their place among the open elements
    parts: list[str] = []
    linked: list[bool] = []  # which of them are text of links
    open_: list[str] = []  # open elements, outermost first
    places: defaultdict[str, list[int]] = defaultdict(list)  # where in them each name is
    skip = -1  # where in them the hidden element is
    marked = 0  # open boxes of marked content
    at = 0

    def flush() -> None:
        text = " ".join(unescape("".join(parts)).split())
        if text:
            own = " ".join(unescape("".join(t for t, link in zip(parts, linked) if not link)).split()) if any(linked) else text
            boxes[-1][1].items.append(Line(text, len(own), bool(places["li"])))
        parts.clear()
        linked.clear()

    def take(text: str) -> None:
        parts.append(text)
        linked.append(bool(places["a"]))

    def innermost(names: set[str]) -> int:
        return max((places[x][-1] for x in names if places.get(x)), default=-1)

    def found(names: set[str], stop: set[str]) -> int:
        """The outermost open element of ``names`` within the innermost of ``stop`` (or that one), or -1."""
        if not any(places.get(x) for x in names):
            return -1
        low = innermost(stop)
        hits = [p[i] for x in names if (p := places.get(x)) and (i := bisect_left(p, low)) < len(p)]
        return min(hits, default=-1)

    def end(to: int) -> None:
        """Ends the open elements from ``to`` on."""
        nonlocal skip, marked
        if boxes[-1][0] >= to:
            flush()
        while boxes[-1][0] >= to:
            _, box = boxes.pop()
            marked -= box.marked
            if box.name in LEAVES and not box.beside and not box.marked and len(box.items) <= 1 and not any(isinstance(x, Box) for x in box.items):
                boxes[-1][1].items.remove(box) if boxes[-1][1].items[-1] is not box else boxes[-1][1].items.pop()
                boxes[-1][1].items += box.items
        if 0 <= to <= skip:
            skip = -1
        for x in reversed(open_[to:]):
            places[x].pop()
        del open_[to:]

    def last_open(name: str) -> int:
        """The innermost open element that an end tag may end, or -1."""
        if not places.get(name):
            return -1
        stop = set() if name in ("html", "body") else {"table"} if name in TABLE else BLOCKS | SCOPE if name in INLINE else SCOPE
        last = places[name][-1]
        return last if last >= innermost(stop | {"ol", "ul"} if name == "li" else stop) else -1

    def in_head() -> bool:
        return skip >= 0 and open_[skip] == "head"

    n = len(page)
    while at < n:
        m = TOKEN.search(page, at)
        if m is None:
            if skip < 0 or in_head() and page[at:].strip():
                take(page[at:])
            break
        if m.start() > at:
            text = page[at : m.start()]
            if in_head() and text.strip():
                end(skip)
            if skip < 0:
                take(text)
        at = m.end()
        close, name, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name:
            continue
        name = name.lower()
        if name in RAW and not close:
            stop = re.compile(rf"</{name}\b[^>]*>?", re.I).search(page, at)
            raw, at = page[at : stop.start() if stop else n], stop.end() if stop else n
            if everything and name in ("noscript", "textarea", "title"):
                take(raw)
            if name == "title":
                flush()
            continue
        if skip < 0:
            if name not in INLINE:
                flush()
            elif name in ("br", "img"):
                take(" ")
        if close:
            last = last_open(name)
            if last >= 0:
                end(last)
            continue
        if in_head() and name not in IN_HEAD:
            end(skip)
        for names, stop_at in IMPLIED.get(name, ()):
            first = found(names, stop_at)
            if first >= 0:
                end(first)
        if name in VOID or attributes.endswith("/"):
            continue
        places[name].append(len(open_))
        open_.append(name)
        if skip >= 0:
            continue
        if name in HIDDEN and not everything:
            flush()
            skip = len(open_) - 1
            continue
        tokens = _tokens(attributes) if attributes else set()
        main = name in MARKED or bool(tokens & MARKS)
        told = [words for t in tokens if (words := set(WORDS.findall(t))) & BESIDE and words <= BESIDE | PLAIN]
        beside = name not in ("html", "body") and (name in NEVER and not (name == "header" and marked) or any(not main or words & TALK for words in told))
        if name in PARTING or name in LEAVES or main or beside:
            flush()
            box = Box(name, main, beside)
            boxes[-1][1].items.append(box)
            boxes.append((len(open_) - 1, box))
            marked += main
    end(0)
    flush()
    return root


def _tokens(attributes: str) -> set[str]:
    return {t.lower() for m in ATTRIBUTE.finditer(attributes) for t in (m[2] or m[3] or m[4] or "").split()}


def stretches(weights: list[int], window: int, surge: int) -> list[tuple[int, int]]:
    """(rise, dive) of each stretch of lines between dives whose distribution reaches ``surge``."""
    n = len(weights)
    total = [0]
    for w in weights:
        total.append(total[-1] + w)
    # the last lines share the last whole window, so that text does not end on the way
    at = (min(i, max(0, n - window)) for i in range(n))
    sums = [total[min(i + window, n)] - total[i] for i in at]
    out, rise, peak = [], None, 0
    for i, height in enumerate([*sums, 0]):
        if height and rise is None:
            rise, peak = i, height
        elif height:
            peak = max(peak, height)
        elif rise is not None:
            if peak >= surge:
                out.append((rise, i))
            rise = None
    return out


def _height(box: Box, window: int) -> int:
    """The highest surge of a box's own lines."""
    w = [x for item in box.items for x in ([item.weight] if isinstance(item, Line) else [0] * (window if item.name in REGIONS else 1))]
    total = list(accumulate(w, initial=0))
    return max((total[min(i + window, len(w))] - total[i] for i in range(len(w))), default=0)


def _chosen(box: Box, window: int, surge: int, marked: bool) -> tuple[set[int], set[int]]:
    """The items of a box that lie in its stretches: lines, and elements between two of them."""
    places = [i for i, item in enumerate(box.items) for _ in range(window if isinstance(item, Box) and item.name in REGIONS else 1)]
    weights = [box.items[i].weight if isinstance(box.items[i], Line) else 0 for i in places]
    link = lambda i: isinstance(box.items[places[i]], Line) and not weights[i]
    lines: set[int] = set()
    between: set[int] = set()
    end = 0
    for a, b in stretches(weights, window, surge):
        while a and link(a) and link(a - 1):
            a += 1  # links that go on from those before the rise are a menu's end
        if marked and lines:  # paragraphs that are links do not part marked content, lists of links do
            lines |= {places[i] for i in range(end, a) if link(i) and not box.items[places[i]].item}
        own = [places[i] for i in range(a, b) if isinstance(box.items[places[i]], Line)]
        lines |= set(own)
        between |= {i for i in range(own[0], own[-1]) if isinstance(box.items[i], Box)} if own else set()
        end = b
    return lines, between


def blocks(page: str, window: int = WINDOW, surge: float = SURGE, marks: bool = True, names: bool = True) -> list[str]:
    """The blocks between rise and dive, in page order.

    ``marks``: elements marked as main content are heeded; ``names``: elements beside the main text are left out by name.
    """
    root = tree(page)
    # (box, whether in marked content) in page order
    boxes: list[tuple[Box, bool]] = []
    todo = [(root, False)]
    while todo:
        box, inside = todo.pop()
        if names and box.beside:
            continue
        inside |= marks and box.marked
        boxes.append((box, inside))
        todo += [(x, inside) for x in reversed(box.items) if isinstance(x, Box)]
    hold = lambda which: any(isinstance(x, Line) for box, _ in which for x in box.items)
    main = [x for x in boxes if x[1]]
    marked = hold(main)
    if marked:
        boxes = main
    heights = {id(box): _height(box, window) for box, _ in boxes}
    top = max(heights.values(), default=0)
    if not top:  # nothing but links
        wanted = {id(box): {i for i, x in enumerate(box.items) if isinstance(x, Line)} for box, _ in boxes}
    else:
        need = 1 if marked else max(1, math.ceil(surge * top))
        wanted = {}
        for box, _ in boxes:  # an element comes before those in it
            adopted = id(box) in wanted
            lines, between = _chosen(box, window, 1 if adopted else need, marked or adopted)
            wanted[id(box)] = lines | wanted.get(id(box), set())
            inner = [i for i, x in enumerate(box.items) if isinstance(x, Box) and id(x) in heights]
            # a short element goes with the elements of its name on both sides of it
            high = [i for i in inner if heights[id(box.items[i])] >= need]
            between |= {i for i in inner if high and high[0] < i < high[-1] and {box.items[i].name} == {box.items[j].name for j in (high[bisect_left(high, i) - 1], high[min(bisect_left(high, i), len(high) - 1)])}}
            for i in inner if adopted else between:
                if heights.get(id(box.items[i])):
                    wanted[id(box.items[i])] = set()
    out: list[str] = []
    stack = [(root, 0)]
    while stack:
        box, at = stack.pop()
        keep = wanted.get(id(box), set())
        for i in range(at, len(box.items)):
            x = box.items[i]
            if isinstance(x, Box):
                stack += [(box, i + 1), (x, 0)]
                break
            if i in keep:
                out.append(x.text)
    return out


def main_text(page: str | None) -> str:
    """Main text of a page: blocks joined by an empty line; null or blank pages give an empty text."""
    return "\n\n".join(blocks(page)) if page else ""


def plain_text(page: str | None) -> str:
    """All visible text of a page, a block a line."""
    out: list[str] = []
    stack: list[Line | Box] = [tree(page, everything=True)] if page else []
    while stack:
        x = stack.pop()
        if isinstance(x, Line):
            out.append(x.text)
        else:
            stack += reversed(x.items)
    return "\n".join(out)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(``id_col``, ``url_col``, text, n_chars) of every row; null html gives an empty text.

    Broken markup never fails: elements whose end tags are left out end where HTML says so, others
    that are not closed end with the page or the element around them.  Repeated rows and null ids pass through; an empty table
    gives an empty result.  Time is in proportion to a page's length, however deep its elements.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            text = [main_text(h) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string()), pa.array(list(map(len, text)), pa.int64())], names=[id_col, url_col, "text", "n_chars"])

    refuse((id_col, url_col), ["text", "n_chars"])
    source = texts_of(pages, html_col, id_col, url_col)
    kinds = [source.schema[c].dataType.simpleString() for c in (id_col, url_col)]
    return source.mapInArrow(run, f"`{id_col}` {kinds[0]}, `{url_col}` {kinds[1]}, text string, n_chars long")
