"""Main text of web pages from parser events and text-to-tag ratios.

The standard library's parser streams a page's events.  They become lines: a line ends where a block element
begins or ends, and holds its text, the number of tags in it, the characters inside links, and its place in the
tree of containers.  Scripts, styles, form controls and embedded media have no text of the page and are passed over as
they stream by.  Elements that say to be no content (navigation, page headers and footers, asides, forms, and those
whose role, class or id says menu, advert, notice, comments and the like) carry a mark.

Each line has a text-to-tag ratio: its characters outside links over its tags.  The ratios are smoothed with a
Gaussian kernel and their logarithms clustered by a threshold (two means in one dimension), so that one very
long paragraph leaves the others what they are; lines above it are seeds.

Seeds decide on marks.  If less than ``OUTSIDE`` of the seed text stands outside marked elements, the mark of the
outermost element that holds most of it, and an article or a headline, is ignored: a page inside a form, in a menu that
is never closed or in a wrapper of whatever class keeps its text; for comments it takes the page's headline.  What
is marked with a weak word (related, share, widget) goes unless it has prose of its own.

Seeds decide on the region.  Ratios, smoothing and threshold are taken again over the lines without marks.  The core is
the innermost container that holds nearly all of the seeds.  Inside an ``article`` or ``main`` that element is the
region, and several of them that hold half of the seeds are it together.  Otherwise the region is the outermost
container around the core whose text is not mostly links, and of its blocks beside the core those stay that have
a seed (what is near enough to prose for the smoothing to lift it) or a headline.  Inside the core and inside an
article all lines stay, short ones too, except those of containers without a seed whose text is mostly links.

Character references are decoded, white space inside a line becomes one space, lines are trimmed and joined by
line feeds.

Cases: a null or empty page has an empty text; a page without tags is one line; elements that are never closed
end with their parents or with the page; broken references stay as they are; pages are read whole, in time that is
linear in their length and depth; equal ratios are one cluster, and all are seeds; equal pages, and repeated rows, have
equal texts; an empty table gives an empty table; other columns pass through, but for those named like ``out``
and ``n_chars``, which are replaced.
"""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import in_arrow, python_ready

#: Elements that begin and end lines.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead title tr ul".split())
#: Elements that hold other blocks and may be the content region.
CONTAINERS = frozenset("article body center div main section table tbody td tr html blockquote form nav aside header footer menu search dialog".split())
#: Elements whose content is no text of the page.
LEFT_OUT = frozenset("annotation applet audio button canvas datalist embed head iframe input noframes noscript object option script select style svg template textarea title video".split())
#: Elements that say by their name that they are no content.
MARKED = frozenset("aside dialog footer form menu nav search".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An end tag closes what stands open inside these.
_P_ENDS = BLOCKS - {"title", "option", "legend", "html", "body", "caption", "tbody", "tfoot", "thead", "tr", "td", "th", "li", "dt", "dd"}
_SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "p": ("p",)}
_LISTS = frozenset("ul ol dl table".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs consent cookie cookies disclaimer dropdown footer gdpr login masthead menu menus modal nav navbar navigation newsletter notice notices notification offcanvas overlay pagination paywall popover popup sharing sidebar sidebars signup skip sponsor sponsored subscribe subscription toolbar topbar".split()
)
_COMMENTS = frozenset("comment comments commentlist discussion disqus feedback guestbook replies respond responses".split())
_WEAK = frozenset("hidden promo promoted promotion related share social toc widget widgets".split())
#: A class or id that begins with one of these speaks of the page around, as in has-sidebar or no-ads.
_ABOUT = frozenset("has no not show with without".split())
_SPLIT = re.compile(r"[^a-zA-Z0-9]+|(?<=[a-z])(?=[A-Z])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
SIGMA = 1.0
NEARLY_ALL = 0.9
OUTSIDE = 0.1
#: Marks.
PLAIN, COMMENTS, WEAK = 1, 2, 3


def _mark(attrs: list[tuple[str, str | None]]) -> int:
    """The mark that an element's attributes give it; 0 for none."""
    found = 0
    for name, value in attrs:
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return PLAIN
        if not value:
            continue
        if name in ("class", "id"):
            for token in value.split():
                parts = [x.lower() for x in _SPLIT.split(token) if x]
                if not parts or parts[0] in _ABOUT and len(parts) > 1:
                    continue
                if not _COMMENTS.isdisjoint(parts):
                    return COMMENTS
                if not _WORDS.isdisjoint(parts) or "header" in parts and not {"article", "post", "entry", "section", "page", "content", "title"} & set(parts):
                    found = PLAIN
                elif not found and not _WEAK.isdisjoint(parts):
                    found = WEAK
        elif name == "role" and value.strip().lower() in _ROLES or name == "style" and _HIDDEN.search(value):
            return PLAIN
    return found


class _Line:
    __slots__ = ("links", "node", "parts", "size", "tags")

    def __init__(self, parts: list[tuple[int, str]], tags: int, links: int, size: int):
        self.parts, self.tags, self.size, self.links = parts, tags, size, min(links, size)
        self.node = min(n for n, _ in parts)  # parents have smaller numbers


class Lines(HTMLParser):
    """A page's lines, and its tree: for each node its parent, element name and mark, and the nodes that headlines stand in."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[_Line] = []
        self.parent: list[int] = [0]
        self.kinds: list[str] = ["page"]
        self.marks: list[int] = [0]
        self.headlines: set[int] = set()
        self.open: list[tuple[str, int, bool]] = []  # name, node around it, left out
        self.count: dict[str, int] = {}
        self.here = self.out = self.in_link = self.tags = self.links = 0
        self.part: list[tuple[int, str]] = []

    def end_line(self) -> None:
        if self.part:
            size = len(_joined(self.part))
            if size:
                self.lines.append(_Line(self.part, self.tags, self.links, size))
                self.tags = 0
            self.part = []
            self.links = 0

    def _pop(self) -> str:
        name, around, left_out = self.open.pop()
        self.count[name] -= 1
        if name in BLOCKS:
            self.end_line()
        self.here = around
        self.out -= left_out
        self.in_link -= name == "a"
        return name

    def _close(self, names: tuple[str, ...], within: frozenset[str]) -> None:
        """Close the innermost open element of ``names`` unless one of ``within`` stands inside it."""
        if not any(self.count.get(n) for n in names):
            return
        for i in range(len(self.open) - 1, -1, -1):
            name = self.open[i][0]
            if name in names:
                while len(self.open) > i:
                    self._pop()
                return
            if name in within:
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag in _P_ENDS or tag == "p":
            self._close(("p",), _LISTS | CONTAINERS - {"blockquote"} | LEFT_OUT)
        if tag in _SIBLINGS and tag != "p":
            self._close(_SIBLINGS[tag], _LISTS)
        if tag in BLOCKS:
            self.end_line()
        if tag in VOID:
            if tag in ("br", "hr") and not self.out:
                self.part.append((self.here, " "))
            return
        mark, left_out, around = 0, tag in LEFT_OUT, self.here
        if tag in ("html", "body"):
            if tag == "body":
                self._close(("head",), frozenset())
        elif tag in MARKED or tag == "header" and not any(self.count.get(n) for n in ("article", "main", "section")):
            mark = PLAIN  # the header of an article has its headline
        elif attrs:
            mark = _mark(attrs)
        if mark or tag in CONTAINERS:
            self.parent.append(around)
            self.kinds.append(tag)
            self.marks.append(mark)
            self.here = len(self.kinds) - 1
        if tag == "h1" and not self.out:
            self.headlines.add(self.here)
        self.open.append((tag, around, left_out))
        self.count[tag] = self.count.get(tag, 0) + 1
        self.out += left_out
        self.in_link += tag == "a"

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag in ("svg", "math") or tag in ("path", "use", "circle", "rect", "g"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCKS:
            self.end_line()
        if tag == "br" and not self.out:
            self.part.append((self.here, " "))
        elif self.count.get(tag):
            while self._pop() != tag:
                pass

    def handle_data(self, data: str) -> None:
        if self.out:
            return
        self.part.append((self.here, data))
        if self.in_link:
            self.links += len(data)


def _joined(parts: list[tuple[int, str]]) -> str:
    return " ".join("".join([x for _, x in parts]).split())


def smoothed(values: list[float], sigma: float = SIGMA) -> list[float]:
    """Gaussian smoothing; at the ends the kernel is cut off and weighted anew."""
    reach = max(1, math.ceil(2 * sigma))
    kernel = [math.exp(-((d / sigma) ** 2) / 2) for d in range(-reach, reach + 1)]
    out, n = [], len(values)
    for i in range(n):
        lo, hi = max(0, i - reach), min(n, i + reach + 1)
        k = kernel[lo - i + reach : hi - i + reach]
        out.append(sum(a * b for a, b in zip(values[lo:hi], k, strict=True)) / sum(k))
    return out


def threshold(values: list[float]) -> float:
    """The border between two clusters of ``values``: two means, from the least and the largest."""
    low, high = min(values), max(values)
    for _ in range(100):
        border = (low + high) / 2
        below, above = [v for v in values if v < border], [v for v in values if v >= border]
        if not below or not above:
            return low
        now = sum(below) / len(below), sum(above) / len(above)
        if now == (low, high):
            break
        low, high = now
    return (low + high) / 2


def _seeds(lines: list[_Line]) -> tuple[list[int], float]:
    """Characters outside links of each line that is a seed, 0 of others; and the border between the clusters."""
    ratios = [math.log1p(r) for r in smoothed([(x.size - x.links) / max(1, x.tags) for x in lines])]
    border = threshold(ratios)
    return [x.size - x.links if r >= border else 0 for x, r in zip(lines, ratios, strict=True)], border


def _sums(parent: list[int], lines: list[_Line], values: list[int]) -> list[int]:
    """The sum of the lines' values in each node and all nodes below it."""
    total = [0] * len(parent)
    for x, v in zip(lines, values, strict=True):
        total[x.node] += v
    for node in range(len(parent) - 1, 0, -1):
        total[parent[node]] += total[node]
    return total


def _below(parent: list[int], chosen: set[int]) -> list[bool]:
    """Whether each node is one of ``chosen`` or stands below one."""
    out = [0 in chosen] * len(parent)
    for node in range(1, len(parent)):
        out[node] = out[parent[node]] or node in chosen
    return out


def _ignored_marks(p: Lines) -> None:
    """Take away the marks of elements that hold what the page is about."""
    seeds, _ = _seeds(p.lines)
    weight = _sums(p.parent, p.lines, seeds)
    inner: dict[int, list[int]] = {}  # marked elements by the marked element next around them; 0 for none
    above = [0] * len(p.parent)
    for n in range(1, len(p.parent)):
        above[n] = above[p.parent[n]]
        if p.marks[n] in (PLAIN, COMMENTS):
            inner.setdefault(above[n], []).append(n)
            above[n] = n
    titled = _around(p, p.headlines | {n for n, k in enumerate(p.kinds) if k == "main"})
    holding = titled | _around(p, {n for n, k in enumerate(p.kinds) if k == "article"})

    def opened(n: int) -> int:
        """Seed text right in ``n``; the elements marked inside it come next."""
        for m in inner.get(n, ()):
            if m in (titled if p.marks[m] == COMMENTS else holding):
                heapq.heappush(next_, (-weight[m], m))
        return weight[n] - sum(weight[m] for m in inner.get(n, ()))

    next_: list[tuple[int, int]] = []
    outside = opened(0)
    while next_ and outside < OUTSIDE * weight[0]:
        w, n = heapq.heappop(next_)
        if -2 * w < weight[0]:
            return
        p.marks[n] = 0
        outside += opened(n)


def _around(p: Lines, nodes: set[int]) -> set[int]:
    """``nodes`` and all nodes around them."""
    out: set[int] = set()
    for n in nodes:
        while n and n not in out:
            out.add(n)
            n = p.parent[n]
    return out


def _without_marked(p: Lines) -> list[_Line]:
    """The lines, or the parts of them, that stand in no marked element."""
    out = _below(p.parent, {n for n, m in enumerate(p.marks) if m in (PLAIN, COMMENTS)})
    kept = []
    for x in p.lines:
        if any(out[n] for n, _ in x.parts):
            parts = [(n, t) for n, t in x.parts if not out[n]]
            size = len(_joined(parts))
            if size:
                kept.append(_Line(parts, x.tags, x.links, size))
        else:
            kept.append(x)
    return kept


def _without_weak(p: Lines, lines: list[_Line]) -> list[_Line]:
    """``lines`` without those in weakly marked elements that are mostly links or have no line with a seed's own ratio."""
    weak = [n for n, m in enumerate(p.marks) if m == WEAK]
    if not weak:
        return lines
    _, border = _seeds(lines)
    size, links = _sums(p.parent, lines, [x.size for x in lines]), _sums(p.parent, lines, [x.links for x in lines])
    prose = _sums(p.parent, lines, [math.log1p((x.size - x.links) / max(1, x.tags)) >= border for x in lines])
    out = _below(p.parent, {n for n in weak if not prose[n] or 2 * links[n] > size[n]})
    return [x for x in lines if not out[x.node]]


def _content(p: Lines, lines: list[_Line]) -> list[_Line]:
    """The lines of the content region."""
    seeds, _ = _seeds(lines)
    weight = _sums(p.parent, lines, seeds)
    size, links = _sums(p.parent, lines, [x.size for x in lines]), _sums(p.parent, lines, [x.links for x in lines])
    core = max(n for n, w in enumerate(weight) if w >= NEARLY_ALL * weight[0])  # numbers grow inwards
    around = [core]
    while around[-1]:
        around.append(p.parent[around[-1]])
    named = [n for n, k in enumerate(p.kinds) if k in ("article", "main")]
    holding = [n for n in around if p.kinds[n] in ("article", "main")]
    named_in = _below(p.parent, set(named))
    in_named = sum(s for x, s in zip(lines, seeds, strict=True) if named_in[x.node])
    if holding:
        inside = _below(p.parent, {holding[-1]})
        kept = [x for x in lines if inside[x.node]]
    elif named and 2 * in_named >= weight[0]:
        kept = [x for x in lines if named_in[x.node]]
    else:
        region = next((n for n in reversed(around) if 2 * links[n] <= size[n]), core)
        inside, in_core = _below(p.parent, {region}), _below(p.parent, {core})
        block, has = list(range(len(p.parent))), set()
        path = set(around)
        for n in range(1, len(p.parent)):  # the block beside the core that a node is in
            if p.parent[n] not in path:
                block[n] = block[p.parent[n]]
        titled = {block[h] for h in p.headlines}
        for x, s in zip(lines, seeds, strict=True):
            if s:
                has.add(block[x.node])
        kept = [x for x, s in zip(lines, seeds, strict=True) if in_core[x.node] or inside[x.node] and (s if block[x.node] in path else block[x.node] in has) or inside[x.node] and block[x.node] in titled]
    own: dict[int, list[int]] = {}
    chosen = set(map(id, kept))
    for x, s in zip(lines, seeds, strict=True):
        if id(x) in chosen:
            o = own.setdefault(x.node, [0, 0, 0])
            o[0] += x.links
            o[1] += x.size
            o[2] += s
    return [x for x in kept if (o := own[x.node])[2] or 2 * o[0] <= o[1]]


def main_text(html: str | None) -> str:
    if not html:
        return ""
    p = Lines()
    p.feed(html)
    p.close()
    while p.open:
        p._pop()
    p.end_line()
    if not p.lines:
        return ""
    _ignored_marks(p)
    lines = _without_marked(p)
    lines = _without_weak(p, lines) if lines else lines
    return "\n".join(_joined(x.parts) for x in _content(p, lines)) if lines else ""


def extract(df: DataFrame, html: str = "html", out: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add ``out`` (the main text) and ``n_chars`` to the columns ``keep`` (all)."""
    python_ready(df.sparkSession)
    stay = [c for c in (df.columns if keep is None else keep) if c.lower() not in (out.lower(), "n_chars")]
    fields = [*[df.schema[c] for c in stay], T.StructField(out, T.StringType()), T.StructField("n_chars", T.LongType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x) for x in b.column(html).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in stay], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*stay, out, "n_chars"])

    return in_arrow(df, run, T.StructType(fields))
