"""Operator 4: main text of web pages by tag-path ratios.

For each page, text and punctuation are summed per root-to-leaf path of block tags. A path's ratios are characters and
punctuation marks per text node; along the page both ratios are smoothed and fused (their product), and the mean over a
path's nodes is its value. Parts that their tag, role, class or id mark as boilerplate have paths of their own, of which a
thousandth of the ratio counts. Paths whose value reaches the threshold (the spread of the fused values) select the content
nodes.

Short blocks of an article (headings, list items, single lines) lie on paths below the threshold. Such a block is kept if
most of the text in its container is on selected paths, unless it is marked or mostly links.

Each page is handled on its own within Arrow batches, in time linear in its length: no shuffle, whole pages.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from linkrisk.functions.markup import Markup, closes_itself

# HTML's tag classes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split()
)
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split()
)
#: start tag: the open tags that it ends, and the tags that such an end does not go beyond.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("table", "tr")),
    "th": (("td", "th"), ("table", "tr")),
    "option": (("option",), ("select",)),
}
ENDS_P = (("p",), ("article", "div", "td", "section", "main", "button"))
NOTHING = ((), ())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

# What is hardly part of an article, by tag, by role, and by words of class and id.
MARKED_TAGS = frozenset("nav footer aside select button svg canvas object audio video menu dialog fieldset datalist".split())
MARKED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
MARKED_NAMES = frozenset(
    """ad ads adv advert adverts advertisement advertising adbox adsense banner banners sponsor sponsored promo promos promotion nav navbar navigation menu menus
    breadcrumb breadcrumbs header masthead topbar footer sidebar sidebars aside rail widget widgets cookie cookies consent notice notices gdpr
    popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations
    comment comments respond replies disqus discussion pagination pager toolbar copyright""".split()
)
COMMENT_NAMES = frozenset("comment comments respond replies disqus".split())
#: Of these, words that sections of an article have too; within an article their ratios decide.
WEAK_NAMES = frozenset("header discussion notice notices social related consent copyright rail".split())
ROOTS = ("article", "main")
#: What counts of the ratio of marked parts.
MARKED = 0.001
#: A container's least share of text on selected paths.
SHARE = 0.5

ATTR = re.compile(r"(?<![^\s=\"'/])([^\s=\"'/]++)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++))")
NAME_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？]")


@dataclass(slots=True)
class Node:
    """An element. ``hint``: "" or why it may be boilerplate: tag, name, weak (name) or comment."""

    tag: str
    up: Node | None
    hint: str = ""
    rooted: bool = False
    marked: bool = False
    path: int = 0
    roots: int = 0
    titles: int = 0
    paragraphs: int = 0
    chars: int = 0
    selected: int = 0
    open: str = ""


@dataclass(slots=True)
class Block:
    """A run of text in one block element."""

    at: Node
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    said: str = ""


def hint_of(tag: str, attrs: str, rooted: bool) -> str:
    """Why an element may be boilerplate."""
    if tag in MARKED_TAGS or tag == "header" and not rooted:
        return "tag"
    name = "name" if tag == "form" else ""
    if "=" not in attrs and "hidden" not in attrs or tag in ("html", "body"):
        return name
    found = {k.lower(): a or b or c for k, a, b, c in ATTR.findall(attrs)}
    if re.search(r"(?:^|\s)hidden(?=[\s/]|$)", ATTR.sub(" ", attrs)) or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", found.get("style", "")):
        return "tag"
    words = {w.lower() for w in NAME_WORDS.findall(f"{found.get('class', '')} {found.get('id', '')}")}
    if words & COMMENT_NAMES:
        return "comment"
    if tag in ROOTS:
        return name
    if words & (MARKED_NAMES - WEAK_NAMES) or found.get("role", "").lower() in MARKED_ROLES:
        return "name"
    return "weak" if words & WEAK_NAMES else name


class Page:
    """A page's elements and text blocks in order."""

    def __init__(self, page: str):
        self.nodes = [Node("", None)]
        self.blocks = [Block(self.nodes[0])]
        self.read(page)
        self.blocks = [b for b in self.blocks if b.said]
        self.mark()

    def read(self, page: str) -> None:
        stack = [self.nodes[0]]
        places: dict[str, list[int]] = defaultdict(list)
        current, links, pos = self.blocks[0], 0, 0
        markup = Markup(page)

        def say(text: str) -> None:
            if text:
                current.parts.append(text)
                if links:
                    current.linked += len(text)

        def fresh() -> Block:
            if current.parts or current.at is not stack[-1]:
                self.blocks.append(Block(stack[-1]))
            return self.blocks[-1]

        def close_to(n: int) -> None:
            while len(stack) > n:
                places[stack.pop().tag].pop()

        def lowest_open(tags: tuple[str, ...], above: int) -> int:
            """The lowest place above ``above`` in the stack of an element with one of the tags, or 0."""
            found = [p[k] for t in tags if (p := places.get(t)) and (k := bisect_right(p, above)) < len(p)]
            return min(found, default=0)

        while found := markup.find(pos):
            say(page[pos : found.begin])
            pos, tag, ending = found.end, found.name, found.ending
            if not tag:
                continue
            if tag in INLINE:
                if tag == "a":
                    links = 0 if ending else 1
                continue
            if tag in VOID:
                if tag in ("br", "hr"):
                    current = fresh()
                continue
            if ending:
                if places.get(tag):
                    close_to(places[tag][-1])
                    links = 0
                    current = fresh()
                continue
            if tag in RAW:
                close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, pos)
                pos = close.end() if close else len(page)
                current = fresh()
                continue
            attrs = found.attributes
            closes, beyond = ENDS.get(tag, ENDS_P if tag in CLOSES_P else NOTHING)
            bound = max((places[t][-1] for t in beyond if places.get(t)), default=0)
            if k := lowest_open(closes, bound):
                close_to(k)
            if not closes_itself(attrs) or tag in CLOSES_P:
                up = stack[-1]
                node = Node(tag, up, hint_of(tag, attrs, up.rooted), up.rooted or tag in ROOTS)
                places[tag].append(len(stack))
                stack.append(node)
                self.nodes.append(node)
                links = 0
            current = fresh()
        say(page[pos:])
        for b in self.blocks:
            b.said = " ".join(html.unescape("".join(b.parts)).split())

    def mark(self) -> None:
        """Which parts are marked as boilerplate, and the numbers of paths. A hint counts only where it does not wrap the article."""
        for b in self.blocks:
            b.at.chars += len(b.said)
            b.at.paragraphs += b.at.tag == "p"
        for n in reversed(self.nodes[1:]):
            n.up.chars += n.chars
            n.up.paragraphs += n.paragraphs
            n.up.roots += n.roots + (n.tag in ROOTS and n.hint != "comment")
            n.up.titles += n.titles + (n.tag == "h1")
        whole = self.nodes[0].chars
        paths: dict[tuple[int, str, bool], int] = {}
        for n in self.nodes[1:]:
            holds = n.roots > 0 or n.rooted and n.titles > 0
            most = 2 * n.chars > whole
            wraps = {
                "tag": False,
                "comment": n.roots > 0 and n.titles > 0,
                "name": holds or n.paragraphs > 1 and most,
                "weak": holds or n.paragraphs > 1 and (most or n.rooted),
                "": True,
            }[n.hint]
            n.marked = n.up.marked or not wraps
            n.path = paths.setdefault((n.up.path, n.tag, n.marked), len(paths) + 1)


def smoothed(values: list[float]) -> list[float]:
    """Each value with its neighbours at distance 1 and 2, by Gaussian weights (sigma 1)."""
    weights = [math.exp(-0.5 * d * d) for d in range(3)]
    out = []
    for i in range(len(values)):
        total = weight = 0.0
        for d in range(-2, 3):
            if 0 <= i + d < len(values):
                total += weights[abs(d)] * values[i + d]
                weight += weights[abs(d)]
        out.append(total / weight)
    return out


def path_values(blocks: list[Block]) -> dict[int, float]:
    """Each path's fused ratio: the mean over its nodes of the smoothed text ratio times one plus the smoothed punctuation ratio."""
    chars, marks, nodes = defaultdict(float), defaultdict(float), defaultdict(int)
    for b in blocks:
        nodes[b.at.path] += 1
        chars[b.at.path] += max(0, len(b.said) - 2 * b.linked)
        marks[b.at.path] += len(PUNCTUATION.findall(b.said)) if 2 * b.linked < len(b.said) else 0
    text_ratio = smoothed([chars[b.at.path] / nodes[b.at.path] for b in blocks])
    mark_ratio = smoothed([marks[b.at.path] / nodes[b.at.path] for b in blocks])
    values = defaultdict(float)
    for b, t, p in zip(blocks, text_ratio, mark_ratio, strict=True):
        values[b.at.path] += t * (1 + p) * (MARKED if b.at.marked else 1) / nodes[b.at.path]
    return dict(values)


def threshold(blocks: list[Block], values: dict[int, float]) -> float:
    """The spread of the values along the page, but no more than half the largest."""
    along = [values[b.at.path] for b in blocks]
    mean = sum(along) / len(along)
    return min(math.sqrt(sum((v - mean) ** 2 for v in along) / len(along)), max(along) / 2)


def selected(page: Page) -> list[Block]:
    """The blocks on paths that reach the threshold, and short ones of the same containers."""
    blocks = page.blocks
    values = path_values(blocks)
    least = threshold(blocks, values)
    chosen = [values[b.at.path] >= least for b in blocks]
    for n in page.nodes:
        n.chars = 0
    for b, good in zip(blocks, chosen, strict=True):
        if not b.at.marked:
            b.at.chars += len(b.said)
        b.at.selected += good * len(b.said)
    for n in reversed(page.nodes[1:]):
        n.up.chars += n.chars
        n.up.selected += n.selected
    # whether other blocks in an element are kept: always, between selected ones, or not ("")
    page.nodes[0].open = "between"
    for n in page.nodes[1:]:
        most = n.selected >= SHARE * n.chars and n.selected > 0
        if n.marked or n.hint == "weak" and not most:
            n.open = ""
        elif n.tag in ROOTS and most or n.up.open == "root":
            n.open = "root"
        elif n.tag in ("html", "body"):
            n.open = "between"
        elif n.tag in ("div", "section", "form", "center", *ROOTS):
            n.open = "always" if most else ""
        else:
            n.open = n.up.open
    at = [i for i, good in enumerate(chosen) if good]
    first, last = at[0], at[-1]
    kept = []
    for i, (b, good) in enumerate(zip(blocks, chosen, strict=True)):
        if not good and not b.at.marked and 2 * b.linked <= len(b.said):
            inside = b.at.up.open if b.at.up is not None and not b.at.open else b.at.open
            before_content = b.at.tag in HEADINGS and i + 1 < len(blocks) and chosen[i + 1]
            good = inside in ("root", "always") or inside == "between" and first < i < last or before_content
        if good:
            kept.append(b)
    return kept


def main_text(page: str | None) -> str:
    """The page's main text, "" if it has none."""
    made = Page(page or "")
    if all(b.at.marked for b in made.blocks):
        return ""
    return " ".join(b.said for b in selected(made))


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """``key``, ``url``, ``text`` and ``n_chars`` (code points) per page.

    A null or empty page, or one without text, gives "" and 0. Repeated rows give repeated results, pages of any length are
    read whole, other columns are ignored, an empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(v.as_py()) for v in batch.column(2)]
            columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "url", "text", "n_chars"])

    rows = pages.select(pages[key].alias("key"), pages[url].alias("url"), pages[page].alias("html"))
    kind = pages.schema[key].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, url string, text string, n_chars long").withColumnRenamed("key", key)


def digest(spark: SparkSession, pages: DataFrame) -> DataFrame:
    return extract(pages)
