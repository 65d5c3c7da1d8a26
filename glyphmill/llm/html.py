"""Main-text extraction: parser events, text-to-tag ratios, Gaussian smoothing, threshold clustering.

The standard library's parser streams through the page once.  Its events give blocks of text (the
"lines" of the method) and the boxes they stand in (sections, divisions, cells and the like).
Each line has a ratio of text outside links to tags; the logarithms of the ratios are smoothed
along the page and split into high and low lines by the threshold of a two-means clustering.

The ratios choose the region: a box is content where it has a high line, and what stands between
its first and its last high part belongs to it, as do short paragraphs beside high lines and
headings before them.  Boxes without high lines, such as menus and lists of links, are left out.
Markup gives hints only: footers, forms, scripts and what class names call adverts, comments and
so on never count as lines (unless a page has no others), and what an article or main element
holds is not left out for being short.
"""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import dealt_table, map_batches

#: Elements of HTML by kind.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter output picture q rp rt ruby s samp small source span strike strong sub sup time tt u var wbr".split())
BOXES = set("html body div section article main nav center table tbody tr td th".split())
UNSEEN = set("head title script style noscript template iframe object svg math canvas audio video map datalist".split())
IN_HEAD = set("title meta link style script base noscript template object".split())
BOILERPLATE = set("header footer aside form button select textarea dialog menu".split())
ROLES = set("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
TEXTS = set("p li dt dd blockquote pre figcaption caption td th address".split()) | HEADINGS
#: Words of class and id attributes that name boilerplate, and words that may stand beside them.
NAMES = set("""ad ads adv advert adverts advertisement advertisements advertising adbox adslot adsense sponsor sponsored sponsors promo promos promotion banner sidebar sidebars sidenav aside menu menus
nav navbar navigation breadcrumb breadcrumbs footer header masthead topbar toolbar cookie cookies consent gdpr notice notices notification notifications alert alerts popup modal
overlay newsletter subscribe subscription signup login register share sharing social related recommended recommendations comment comments commentlist disqus
reply replies respond discussion widget widgets pagination pager copyright disclaimer paywall search""".split())
BESIDE = set("""area article articles bar block blocks body bottom box btn button buttons col column container content div entry feed foot form global group head heading info
inline inner item items label layer left link links list lists main message messages module modules no outer page pane panel part post posts primary reader readers region right row secondary
section sections short side site slot small sticky stories story text the thread title top unit user users wrap wrapper zone""".split()) - {"no"}
#: Opening one of the keys ends an open one of its values, up to the next list or table.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
STOPS = ("ul", "ol", "dl", "table", "select", "menu")


@dataclass(slots=True)
class Node:
    tag: str
    up: Node | None
    box: Node | None = None  # the nearest box that it is or stands in
    named: bool = False  # by its attributes, as boilerplate
    heads: bool = False  # named by a word for headers alone
    unseen: bool = False
    inside: bool = False  # an article or main, or in one
    among_named: bool = False  # in one that is named
    first_article: bool = False  # the first article or main stands in it, of those that stand in nothing named if there are any
    out: bool = False  # it or what it stands in is left out
    mode: int = 0  # of a box, see _choose
    parts: list[Line | Node] = field(default_factory=list)  # lines and boxes in a box, in order
    high: int = 0  # high lines in it
    chars: int = 0
    linked: int = 0


@dataclass(slots=True)
class Line:
    text: str
    node: Node
    tags: int
    linked: int
    high: bool = False
    kept: bool = False

    @property
    def links(self) -> bool:
        """Whether most of it stands in links."""
        return 2 * self.linked >= len(self.text)


def _words(name: str) -> list[str]:
    """The words of a class or id, parted at capitals and what is no letter; what follows `--` only modifies."""
    return [w.lower() for w in re.findall(r"[A-Z]*[a-z]+|[A-Z]+", name.split("--")[0]) if len(w) > 1]


def _named(attrs: list[tuple[str, str | None]]) -> tuple[bool, bool, bool]:
    """Boilerplate by name; by a word for headers alone; not shown."""
    found: set[str] = set()
    role = unseen = False
    for name, value in attrs:
        value = value or ""  # noqa: PLW2901
        if name in ("class", "id"):
            for token in value.split():
                words = _words(token)
                if all(w in NAMES or w in BESIDE for w in words):
                    found |= NAMES.intersection(words)
        elif name == "role":
            role |= value.lower() in ROLES
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value.lower()):
            unseen = True
    return bool(found) or role, bool(found) and found <= {"header", "masthead"} and not role, unseen


class Lines(HTMLParser):
    """The lines of a page, from parser events, in time that is linear in its tags however deep they nest."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        root = Node("html", None)
        root.box = root
        self.stack = [root]  # open elements
        self.depths: dict[str, list[int]] = defaultdict(list)  # of the open elements of a tag
        self.events: list[Node | Line] = [root]  # elements and lines, in order
        self.data: list[str] = []
        self.tags = self.links = self.linked = 0
        self.article = False  # one has been met outside of what is named
        self.first: list[Node] = []  # the first such, or else the first of all, and what it stands in

    def parse_html_declaration(self, i: int) -> int:
        """Marked sections (`<![...`) have no meaning in HTML: they are comments, up to the next `>`."""
        if self.rawdata.startswith("<![", i):
            return self.parse_bogus_comment(i)
        return super().parse_html_declaration(i)

    def flush(self) -> None:
        if self.data:
            text = " ".join("".join(self.data).split())
            if text:
                self.events.append(Line(text, self.stack[-1], self.tags, self.linked))
                self.tags = 0
            self.data, self.linked = [], 0

    def _close(self, depth: int) -> None:
        """Ends the open elements from this depth on."""
        while len(self.stack) > depth:
            self.depths[self.stack.pop().tag].pop()

    def _last(self, tags: tuple[str, ...]) -> int:
        return max((self.depths[t][-1] for t in tags if self.depths[t]), default=0)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag in INLINE:
            if tag == "a":
                self.links += 1
            elif tag == "br":
                self.data.append(" ")
            if not attrs or tag in VOID:
                return
        named, heads, unseen = _named(attrs) if attrs else (False, False, False)
        if tag in INLINE and not (named or unseen):
            return
        self.flush()
        if self.depths["head"] and tag not in IN_HEAD:
            self._close(self.depths["head"][-1])
        if tag in VOID or tag in ("html", "body"):
            return
        self.links = 0
        if self.stack[-1].tag == "p" or self.stack[-1].tag in HEADINGS and tag in HEADINGS:
            self._close(len(self.stack) - 1)
        if tag in ENDS and (at := self._last(ENDS[tag])) > self._last(STOPS):
            self._close(at)
        up = self.stack[-1]
        node = Node(tag, up, None, named, heads, unseen or tag in UNSEEN, up.inside or tag in ("article", "main"))
        node.among_named = up.among_named or up.named
        node.box = node if tag in BOXES or tag in BOILERPLATE or named else up.box
        self.depths[tag].append(len(self.stack))
        self.stack.append(node)
        self.events.append(node)
        if tag in ("article", "main") and not self.article and not named:
            # once a page, and once more for one that stands in what is named: this is linear too
            if not node.among_named:
                self.article = True
                self.first = list(self.stack)
            elif not self.first:
                self.first = list(self.stack)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag in ("script", "iframe", "svg") and self.stack[-1].tag == tag:
            self._close(len(self.stack) - 1)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag == "a":
            self.links = max(0, self.links - 1)
        if self.depths[tag]:
            self.flush()
            self._close(self.depths[tag][-1])
        elif tag not in INLINE:
            self.flush()

    def handle_data(self, data: str) -> None:
        self.data.append(data)
        if self.links:
            self.linked += len(data)


#: Character references of more digits than the parser turns to numbers.
_LONG_REFERENCE = re.compile(r"&#0*([0-9]{1000,});?")


def lines_of(html: str) -> Lines:
    """The parsed page.  What the parser can't go on with ends the page there."""
    at = html.rfind("<!--")
    if at >= 0 and html.find("-->", at) < 0 and html.find("</", at) < 0:
        html = html[:at]  # a comment that never ends
    parser = Lines()
    try:
        parser.feed(_LONG_REFERENCE.sub("\ufffd", html))
        parser.close()
    except (AssertionError, ValueError):
        pass
    parser.flush()
    for node in parser.first:
        node.first_article = True
    return parser


def smooth(x: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian smoothing; the ends are padded with zeros and renormalized."""
    reach = max(1, int(3 * sigma))
    kernel = np.exp(-(np.arange(-reach, reach + 1) ** 2) / (2 * sigma * sigma))
    return np.convolve(x, kernel)[reach : reach + len(x)] / np.convolve(np.ones_like(x), kernel)[reach : reach + len(x)]


def threshold(x: np.ndarray) -> float:
    """The midpoint of the two means that cluster the values; the least value where there is one cluster."""
    low, high = float(x.min()), float(x.max())
    for _ in range(32):
        cut = (low + high) / 2
        above = x >= cut
        if above.all():
            return float(x.min())
        new = float(x[~above].mean()), float(x[above].mean())
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2


def ratios(lines: list[Line]) -> np.ndarray:
    """Characters outside links to tags, of each line."""
    return np.array([max(0, len(x.text) - x.linked) / max(1, x.tags) for x in lines])


def _leave_out(nodes: list[Node], by_name: bool) -> None:
    """Marks what hints leave out; parents come before children."""
    for node in nodes:
        inside = bool(node.up and node.up.inside)
        by_tag = node.tag in BOILERPLATE and not (node.tag == "header" and inside)
        named = node.named and not node.first_article and not (node.heads and inside)
        node.out = bool(node.up and node.up.out) or node.unseen or by_tag or by_name and named


DROP, WALK, ALL = range(3)


def _boxed(events: list[Node | Line]) -> list[Node]:
    """The boxes that aren't left out, parents first, each with its parts in order and the sums of its lines."""
    boxes: list[Node] = []
    for event in events:
        if isinstance(event, Line):
            if not event.node.out:
                event.node.box.parts.append(event)
        elif event.box is event and not event.out:
            event.parts, event.high, event.chars, event.linked, event.mode = [], 0, 0, 0, DROP
            boxes.append(event)
            if event.up:
                event.up.box.parts.append(event)
    for box in reversed(boxes):
        for part in box.parts:
            box.high += part.high
            box.chars += len(part.text) if isinstance(part, Line) else part.chars
            box.linked += part.linked
    return boxes


def _choose(boxes: list[Node]) -> None:
    """Marks the lines that are kept, from those that are high."""
    boxes[0].mode = WALK
    for box in boxes:
        # a box with nothing but one line counts as a line of the box around it
        parts = [(p.parts[0], p.tag) if isinstance(p, Node) and len(p.parts) == 1 and isinstance(p.parts[0], Line) else (p, p.node.tag if isinstance(p, Line) else p.tag) for p in box.parts]
        if box.mode == ALL:
            for part, _ in parts:
                if isinstance(part, Line):
                    part.kept = True
                else:
                    part.mode = ALL
        if box.mode != WALK:
            continue
        hot = [k for k, (part, _) in enumerate(parts) if part.high]
        direct = any(isinstance(parts[k][0], Line) for k in hot)
        for k, (part, tag) in enumerate(parts):
            between = bool(hot) and hot[0] < k < hot[-1]
            if isinstance(part, Line):
                beside = tag in TEXTS and direct or tag in HEADINGS and bool(hot) and k < hot[-1]
                part.kept = part.high or between or (box.inside or beside) and not part.links or box.inside and tag in TEXTS and tag != "li"
            elif part.high:
                part.mode = WALK
            elif (box.inside or between) and 2 * part.linked < part.chars:
                part.mode = ALL


def main_text(html: str, sigma: float = 1.0) -> str:
    """The main text of a page; empty if it has none.

    sigma: of the smoothing, in lines.  Where no line with text outside links is left beside what
    class names call boilerplate, names don't count.
    """
    page = lines_of(html)
    for by_name in (True, False):
        _leave_out([e for e in page.events if isinstance(e, Node)], by_name)
        lines = [e for e in page.events if isinstance(e, Line) and not e.node.out]
        found = ratios(lines)
        if not lines or not found.any():
            continue
        smoothed = smooth(np.log1p(found), sigma)
        for line, high in zip(lines, (smoothed >= threshold(smoothed)).tolist(), strict=True):
            line.high = high
        _choose(_boxed(page.events))
        return "\n".join(x.text for x in lines if x.kept)
    return ""


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each row of pages.

    A null or empty page has an empty text; repeated rows are extracted each for itself; malformed
    markup is read as the parser reads it, up to where it can't go on; other columns are ignored.
    """
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(h) if h else "" for h in batch.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], schema=schema)

    need = pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), F.col("html").cast("string"))
    return map_batches(need, each, "page_id bigint, url string, text string, n_chars bigint")


def op10_ratio_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract(dealt_table(spark, sf_dir, "pages"))
