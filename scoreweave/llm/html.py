"""Main text of web pages from streaming parser events and text-to-tag ratios.

The parser's events are gathered into lines (blocks), each with its text, its number of tags, its link text and the element
it stands in. A line's ratio is its characters without links over its tags; ratios are smoothed by a Gaussian along the page, and
lines over the threshold (a share of the page's standard deviation) are clusters of content. The content region is the innermost
element that holds nearly all of the clusters' text (an article or a main that holds most of it, if there is one). Inside the region, ratios
decide again: lines whose own text is links (ratio 0, or next to it) are clusters of their own, and clusters of LINKS lines
or links are menus and go; short lines between long ones score low, too, but have text of their own and stay.

Markup tells what is no part of an article: menus, headers, footers, asides, forms, scripts, and elements
whose class, id or role names a notice, advert, sidebar or comments. A name drops no element that holds most of the page's text,
a main or the longest article (a page's wrapper is often named after its sidebar); ratios decide there.

Work and memory grow with the page, not with the depth of its tags: elements point to their parents, and sums go up these once.

Defined results: a null or empty html, and one without text, give an empty text; nothing is capped; unclosed and stray tags
are taken as they come; repeated rows each get a row; an empty table gives an empty one; other columns play no part.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import need, steps

#: Elements that stand in a line of text (fixed values).
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements without an end tag (fixed values).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that are never part of an article's text (fixed values).
DROPPED = frozenset("script style noscript template nav footer aside form button select textarea iframe object svg canvas audio video head title menu dialog fieldset input".split())
#: Names in class, id, role or aria-label that tell the same (fixed values).
NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|banner|sponsor\w*|promo\w*|nav\w*|menu\w*|breadcrumbs?|sidebar|side|widget\w*|footer|foot|masthead|site-header|page-header|topbar|toolbar|"
    r"cookies?|consent|gdpr|notice|notification|alert|popup|modal|overlay|newsletter|subscribe|signup|login|share|sharing|social|related|recommend\w*|"
    r"comments?|commentlist|replies|reply|respond|disqus|discussion|search|pagination|pager|navigation|complementary|contentinfo|search|legal|copyright|disclaimer|tags|hidden)(?:$|[\s_-])"
    r"|(?:^|\s)(?:header)(?:$|\s)",
    re.I,
)
#: Elements that a page's article may be (fixed values), the surest first.
ARTICLE = ("article", "main")
#: Elements that a start tag closes when they are open in the same container (fixed values).
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
PARENTS = frozenset("ul ol dl table tbody thead tfoot div section article main body blockquote td th".split())
SPACE = re.compile(r"\s+")


#: Lines or links that make a cluster of links a menu.
LINKS = 3


class Line:
    __slots__ = ("anchors", "links", "node", "parts", "tags")

    def __init__(self, node: int) -> None:
        self.parts: list[tuple[str, int, bool]] = []  # text, the innermost element about it that a name may drop, whether it is a link
        self.tags, self.links, self.anchors, self.node = 1, 0, 0, node

    @property
    def text(self) -> str:
        return SPACE.sub(" ", "".join(t for t, _, _ in self.parts)).strip()

    @property
    def own(self) -> int:
        """Letters and digits that are no links."""
        return sum(sum(map(str.isalnum, t)) for t, _, link in self.parts if not link)

    def without(self, shut: list[bool]) -> Line:
        """The line without what stands in these elements."""
        self.parts = [x for x in self.parts if not shut[x[1]]]
        self.links = sum(len(t) for t, _, link in self.parts if link)
        return self


class Events(HTMLParser):
    """Lines of a page, in order, and its elements: kind, parent, and the innermost element around that a name may drop. Element 0 is the page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.kinds, self.parents, self.named, self.around = ["page"], [0], [False], [0]
        self.open: list[tuple[str, int, bool]] = []  # name, number, whether it is dropped
        self.names: Counter[str] = Counter()  # open elements by name
        self.scopes: list[Counter[str] | None] = [None]  # the same, within each open container (PARENTS)
        self.blocks: list[Counter[str] | None] = [None]  # inline ones, within each open block
        self.places = [0]  # open blocks
        self.dropped = self.links = self.articles = 0
        self.line = Line(0)

    @property
    def within(self) -> int:
        """The innermost open element that a name may drop."""
        n = self.open[-1][1] if self.open else 0
        return n if self.named[n] else self.around[n]

    def cut(self) -> None:
        if self.line.parts:
            self.lines.append(self.line)
        self.line = Line(self.places[-1])

    def push(self, name: str, number: int, dropped: bool) -> None:
        self.open.append((name, number, dropped))
        self.names[name] += 1
        for stacks, fresh in ((self.scopes, name in PARENTS), (self.blocks, name not in INLINE)):
            if fresh:
                stacks.append(None)
            else:
                if stacks[-1] is None:
                    stacks[-1] = Counter()
                stacks[-1][name] += 1
        if name not in INLINE:
            self.places.append(number)
        self.dropped += dropped
        self.links += name == "a"
        self.articles += name in ARTICLE

    def pop(self) -> None:
        name, _, dropped = self.open.pop()
        self.names[name] -= 1
        for stacks, fresh in ((self.scopes, name in PARENTS), (self.blocks, name not in INLINE)):
            if fresh:
                stacks.pop()
            else:
                stacks[-1][name] -= 1
        if name not in INLINE:
            self.places.pop()
        self.dropped -= dropped
        self.links -= name == "a"
        self.articles -= name in ARTICLE

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ("html", "body"):
            return
        inline = tag in INLINE
        shut = CLOSES.get(tag, () if inline else ("p",))
        while (here := self.scopes[-1]) and any(here[x] for x in shut):
            self.pop()
        if tag not in VOID:
            told = " ".join(v for k, v in attrs if v and k in ("class", "id", "role", "aria-label")) if attrs else ""
            drop = tag in DROPPED or tag == "header" and not self.articles or any(k == "hidden" or k == "style" and v and "display:none" in v.replace(" ", "") for k, v in attrs)
            around = self.within
            self.kinds.append(tag)
            self.parents.append(self.places[-1])
            self.named.append(bool(told) and tag not in ARTICLE and bool(NAMES.search(told)))
            self.around.append(around)
            self.push(tag, len(self.kinds) - 1, drop)
        if inline:
            self.line.tags += 1
            self.line.anchors += tag == "a"
            if tag == "br":
                self.line.parts.append((" ", self.within, False))
        else:
            self.cut()

    def handle_endtag(self, tag: str) -> None:
        inline = tag in INLINE
        if not self.names[tag] or inline and not (self.blocks[-1] and self.blocks[-1][tag]):
            return
        while self.open[-1][0] != tag:
            self.pop()
        self.pop()
        if inline:
            self.line.tags += 1
        else:
            self.cut()

    def handle_data(self, data: str) -> None:
        if not self.dropped:
            self.line.parts.append((data, self.within, self.links > 0))

    def upward(self, sums: list[float]) -> list[float]:
        """Each element's sum with those of all elements in it."""
        for n in range(len(sums) - 1, 0, -1):
            sums[self.parents[n]] += sums[n]
        return sums

    def inside(self, chosen: set[int]) -> list[bool]:
        """Whether each element is one of these or stands in one."""
        out = [n in chosen for n in range(len(self.kinds))]
        for n in range(1, len(out)):
            out[n] = out[n] or out[self.parents[n]]
        return out

    def shut(self) -> list[bool]:
        """Whether each element is dropped for a name, its own or one around it: not one that holds most of the page's text, a main, or the
        longest article."""
        sizes, text = [0.0] * len(self.kinds), [0.0] * len(self.kinds)
        for x in self.lines:
            for t, n, _ in x.parts:
                size = len(t.strip())
                sizes[n] += size
                text[x.node] += size
        total = sum(sizes)
        for n in range(len(sizes) - 1, 0, -1):  # from one that may be dropped to the next around it
            if self.named[n]:
                sizes[self.around[n]] += sizes[n]
        text = self.upward(text)
        kept = [False] * len(sizes)
        for kind in ARTICLE:
            of = [n for n, k in enumerate(self.kinds) if k == kind and text[n]]
            for n in of if kind == "main" else [max(of, key=text.__getitem__)] if of else []:
                n = self.around[n]
                while n and not kept[n]:
                    kept[n], n = True, self.around[n]
        out = [False] * len(sizes)
        for n in range(1, len(out)):
            out[n] = self.named[n] and (out[self.around[n]] or not kept[n] and 2 * sizes[n] <= total)
        return out


def smoothed(ratios: np.ndarray, sigma: float) -> np.ndarray:
    radius = max(1, int(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    return np.convolve(np.pad(ratios, radius, mode="edge"), kernel / kernel.sum(), mode="valid")


def menus(own: np.ndarray, links: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """Which lines are in a cluster of links: letters outside links, characters in links, and links, of each line."""
    low = (links > 0) & (own <= 0.25 * links)
    out = np.zeros(len(low), bool)
    edge = np.diff(np.concatenate([[0], low.astype(np.int8), [0]]))
    for a, b in zip(np.nonzero(edge == 1)[0].tolist(), np.nonzero(edge == -1)[0].tolist(), strict=True):
        out[a:b] = b - a >= LINKS or anchors[a:b].sum() >= LINKS
    return out


def main_text(html: str | None, sigma: float = 1.0, threshold: float = 0.5, share: float = 0.9) -> str:
    if not html:
        return ""
    events = Events()
    events.feed(html)
    events.close()
    events.cut()
    shut = events.shut()
    lines = [(x, t) for x in events.lines if (t := x.without(shut).text)]
    if not lines:
        return ""
    nodes = [x.node for x, _ in lines]
    sizes = np.array([max(0, len(t) - x.links) for x, t in lines], float)
    ratios = smoothed(sizes / np.array([x.tags for x, _ in lines], float), sigma)
    content = ratios >= threshold * ratios.std() if len(lines) > 1 else np.ones(1, bool)
    votes = [0.0] * len(events.kinds)
    for n, size, yes in zip(nodes, sizes.tolist(), content.tolist(), strict=True):
        votes[n] += size * yes
    votes = events.upward(votes)
    least = share * votes[0]
    # The innermost element with nearly all of the content; an article that has most of it is one, and so are several.
    region = None
    for kind in ARTICLE:
        within = events.inside({n for n, k in enumerate(events.kinds) if k == kind})
        if any(within) and sum(s for n, s, yes in zip(nodes, sizes, content, strict=True) if yes and within[n]) >= 0.5 * votes[0]:
            region = within
            break
    if region is None:
        best = max((n for n, held in enumerate(votes) if held >= least and (held or not n)), default=0)
        # Text about it that is content and stands in no other element is of the region, too (tags that are never closed).
        count, own, low = ([0.0] * len(votes) for _ in range(3))
        for n, yes in zip(nodes, content.tolist(), strict=True):
            count[n] += 1
            own[n] += 1
            low[n] += not yes
        count, low = events.upward(count), events.upward(low)
        while best and own[up := events.parents[best]] and count[up] - count[best] == own[up] and low[up] == low[best]:
            best = up
        region = events.inside({best})
    chosen = np.array([region[n] for n in nodes])
    menu = menus(np.array([x.own if x.links else 0 for x, _ in lines]), np.array([x.links for x, _ in lines]), np.array([x.anchors for x, _ in lines]))
    if not (chosen & ~menu).any():  # nothing but links: they are the text
        menu[:] = False
    return "\n\n".join(t for (_, t), yes, no in zip(lines, chosen.tolist(), menu.tolist(), strict=True) if yes and not no)


def extract(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text, n_chars."""
    need(pages, "page_id", "url", "html")

    def pull(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in steps(batches, "html"):
            texts = [main_text(h) for h in part.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    kinds = {n: pages.schema[n].dataType.simpleString() for n in ("page_id", "url")}
    out = pages.select("page_id", "url", F.col("html").cast("string").alias("html")).mapInArrow(pull, f"page_id {kinds['page_id']}, url {kinds['url']}, text string")
    return out.withColumn("n_chars", F.length("text").cast("long"))
