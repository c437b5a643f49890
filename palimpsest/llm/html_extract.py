"""The main text of web pages by scores on the element tree (after the Arc90 readability experiment).

One pass over the page builds the tree, with the end tags that HTML lets authors leave out, and its blocks of text. Blocks of
some length give points (one, one a comma, one a hundred characters up to three) to the element that holds the paragraph, half
to the one above and a sixth to the next, and the article or main element around them gets them in full. An element's score
is its points and a weight of its tag, discounted by the share of its text in links.

Menus, footers, forms and the like, and elements with a class, id or role that says so, are marked. A mark is a weight: it
lowers the score of its element and of all in it to a fifth, and no points pass out of it. The element with the best score is
kept, with those siblings that look like it and headings before it; marked elements inside what is kept are left out. So a
wrapper with a misleading class costs an article nothing, and an advert inside it goes."""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm import shared

TOKEN = re.compile(
    r"<!--(?:.*?-->|.*\Z)|<[!?][^>]*(?:>|\Z)|</?([a-zA-Z][^\s/>]*)((?>[^\"'>]+|\"[^\"]*\"|'[^']*')*+)>|</?([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|</[^>]*(?:>|\Z)", re.S
)
ATTR = re.compile(r"([^\s=/\"']+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"']+))?")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup; it is dropped. A script or style without an end tag takes the rest of the page.
RAW = frozenset("script style textarea title noembed noframes xmp iframe".split())
INLINE = frozenset(
    "a abbr acronym area b base bdi bdo big br button cite code data del dfn em embed font i img input ins kbd label link mark meta param q rp rt ruby s samp small source span strike strong sub sup "
    "time track tt u var wbr".split()
)
PARAGRAPH = frozenset("p pre td th li dd dt blockquote h1 h2 h3 h4 h5 h6 figcaption caption".split())
HEADING = frozenset("h1 h2 h3".split())
WHOLE = frozenset(("article", "main"))
#: Elements that are marked by their tag.
MARKED = frozenset("nav footer aside form button select option dialog menu template noscript svg canvas object audio video math map datalist fieldset label".split())
#: Words that mark an element: a class, an id or a role itself, or the first or last word of one with several.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs footer "
    "sidebar aside comment comments commentlist disqus respond replies reply cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe signup share sharing social "
    "related recommended recommendations widget login search searchbox pagination pager toolbar complementary contentinfo alert outbrain taboola".split()
)
#: These mark an element that isn't in an article or main element.
HEADS = frozenset(("header", "masthead"))
#: These mark even an article element, and those inside them.
FOREIGN = frozenset("ad ads advert advertisement comment comments commentlist disqus promo recommended related replies reply respond sponsored".split())
#: First and last words of names that say what isn't there, or how it is set.
NEGATING, SETTING = frozenset("no not non without has with hide".split()), frozenset("enabled disabled on off open closed none free count".split())
WORD = re.compile(r"[a-z0-9]+")
STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: Elements that the start of one ends, inside the nearest of those that hold them. Fixed values of HTML.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tr", "td", "th", "thead", "tbody"), "tfoot": ("tr", "td", "th", "tbody")}
HOLDS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",), "tbody": ("table",), "tfoot": ("table",)}
CELLS = ("table", "td", "th", "caption")
WEIGHT = {"article": 10.0, "main": 10.0, "section": 5.0, "div": 5.0, "blockquote": 3.0, "td": 3.0, "pre": 3.0, "ul": -3.0, "ol": -3.0, "dl": -3.0}
#: Factor of a mark, and the marks around an element that count at most.
PENALTY, MOST_MARKS = 0.2, 3
#: Points that make a marked element, or what is in one, the main text of a page where nothing else scores.
LEAST_MARKED = 8.0
#: Shares of a block's points for the element that holds the paragraph and those above it.
SHARES = (1.0, 1 / 2, 1 / 6)


class Element:
    """marks: marked elements around this one, itself included; home: the article or main element that gets its points.
    Marks don't count for an article or main element in them, unless one is foreign."""

    __slots__ = ("chars", "foreign", "home", "inline", "links", "marked", "marks", "order", "parent", "points", "tag")

    def __init__(self, tag: str, parent: Element | None, order: int, marked: bool = False, foreign: bool = False):
        self.tag, self.parent, self.order, self.marked = tag, parent, order, marked
        self.inline = tag in INLINE or "-" in tag or ":" in tag  # elements of no standard are inline
        self.foreign = foreign or parent is not None and parent.foreign
        self.marks = 0 if tag in WHOLE and not self.foreign else (parent.marks if parent else 0) + marked
        self.home = self if tag in WHOLE else None if marked or parent is None else parent.home
        self.points, self.chars, self.links = 0.0, 0, 0

    def score(self) -> float:
        if self.points <= 0 or not self.chars:
            return 0.0
        return max(self.points + WEIGHT.get(self.tag, 0.0), 0.0) * (1 - self.links / self.chars) * PENALTY ** min(self.marks, MOST_MARKS)


def says(name: str, whole: bool) -> bool:
    """Does a class, an id or a role mark an element? whole: in an article or main element."""
    name = re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name).lower()
    words = WORD.findall(name)
    if not words:
        return False
    if len(words) == 1:
        return words[0] in MARKS or words[0] in HEADS and not whole
    return words[0] not in NEGATING and words[-1] not in SETTING and (words[0] in MARKS or words[-1] in MARKS)


def _marked(tag: str, attrs: str, parent: Element) -> tuple[bool, bool]:
    """Is an element marked, and as foreign?"""
    whole = parent.home is not None
    marked, foreign = tag in MARKED or tag == "header" and not whole, False
    if tag == "body" or not attrs or tag in INLINE and tag != "span":
        return marked, False
    for name, value in ATTR.findall(attrs):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and STYLE.search(value):
            marked = True
        elif name in ("class", "id", "role"):
            tokens = value.split()
            foreign = foreign or any(t.lower() in FOREIGN for t in tokens)
            marked = marked or foreign or tag not in WHOLE and any(says(t, whole) for t in tokens)
    return marked, foreign


class Block:
    """A line of text: the element that holds it, and its runs (element, text as it is written, in a link)."""

    __slots__ = ("holder", "runs")

    def __init__(self, holder: Element, runs: list[tuple[Element, str, bool]]):
        self.holder, self.runs = holder, runs

    def text(self, marks: int) -> str:
        """Without runs inside more marked elements than so many."""
        return " ".join(html.unescape("".join(t for e, t, _ in self.runs if e.marks <= marks)).split())


class Tree:
    """Reads a page; every step takes constant time, on average over the page."""

    def __init__(self, page: str):
        self.elements = [Element("html", None, 0)]
        self.blocks: list[Block] = []
        self.stack, self.open = list(self.elements), defaultdict(list)  # open elements, and their depths by tag
        self.deep = [0]  # depths of those that aren't inline
        self.runs: list[tuple[Element, str, bool]] = []
        self.anchor: Element | None = None
        self.endless: set[str] = set()  # raw elements that have no end tag any more
        self._read(page)

    def _text(self, text: str) -> None:
        if text:
            self.runs.append((self.stack[-1], text, self.anchor is not None))

    def _flush(self) -> None:
        if self.runs:
            if any(not t.isspace() for _, t, _ in self.runs):
                self.blocks.append(Block(self.stack[self.deep[-1]], self.runs))
            self.runs = []

    def _push(self, tag: str, attrs: str) -> None:
        e = Element(tag, self.stack[-1], len(self.elements), *_marked(tag, attrs, self.stack[-1]))
        self.open[tag].append(len(self.stack))
        if not e.inline:
            self.deep.append(len(self.stack))
        self.stack.append(e)
        self.elements.append(e)
        if tag == "a":
            self.anchor = e

    def _pop(self, to: int) -> None:
        while len(self.stack) > to:
            e = self.stack.pop()
            self.open[e.tag].pop()
            if not e.inline:
                self.deep.pop()
            if e is self.anchor:
                self.anchor = None

    def _last(self, tags: tuple[str, ...]) -> int:
        """Depth of the innermost open element with one of the tags, 0 if there is none."""
        return max((self.open[t][-1] for t in tags if self.open[t]), default=0)

    def _end(self, tag: str) -> None:
        if tag in ("html", "body", "head"):
            self._flush()
        elif tag in INLINE or "-" in tag or ":" in tag:
            if tag == "a":
                self.anchor = None
            if (at := self._last((tag,))) > self.deep[-1]:  # an inline end tag doesn't close blocks
                self._pop(at)
        else:
            around = HOLDS["li"] if tag == "li" else ("table",) if tag in CLOSES or tag in CELLS else CELLS
            at = self._last((tag,))
            if at > (0 if tag == "table" else self._last(around)):
                self._flush()
                self._pop(at)

    def _start(self, tag: str, attrs: str) -> None:
        if tag in ("html", "head", "body"):
            self._flush()
            if tag == "body" and not self.open["body"]:
                self._push(tag, attrs)
            return
        if tag in INLINE or "-" in tag or ":" in tag:
            if tag == "a":
                self._end("a")  # links don't nest
            if tag == "br":
                self._text(" ")
        else:
            self._flush()
            if tag in CLOSES:
                at = [d for t in CLOSES[tag] if (d := self._last((t,))) > self._last(HOLDS[tag])]
                if at:
                    self._pop(min(at))
            if (p := self._last(("p",))) > self._last(CELLS):
                self._pop(p)
        if tag not in VOID and not attrs.endswith("/"):
            self._push(tag, attrs)

    def _raw(self, page: str, tag: str, start: int) -> int:
        """Where the content of a raw element ends."""
        if tag not in self.endless:
            m = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(page, start)
            if m:
                return m.end()
            self.endless.add(tag)
        after = page.find("<", start) if tag not in ("script", "style") else -1
        return len(page) if after < 0 else after

    def _read(self, page: str) -> None:
        at, match = 0, TOKEN.search
        while (m := match(page, at)) is not None:
            self._text(page[at : m.start()])
            at = m.end()
            tag = (m[1] or m[3] or "").lower()
            if not tag:
                continue
            if page[m.start() + 1] == "/":
                self._end(tag)
            elif tag in RAW:
                self._text(" ")
                at = self._raw(page, tag, at)
            else:
                self._start(tag, (m[2] if m[1] else m[4]) or "")
        self._text(page[at:])
        self._flush()


def points_of(text: str) -> float:
    """What a block of text gives: nothing if it is short."""
    return 1.0 + text.count(",") + text.count("，") + text.count("、") + min(len(text) // 100, 3) if len(text) >= 25 else 0.0


def weigh(tree: Tree) -> list[str]:
    """Gives the tree's elements their points, characters and characters in links; the texts of the blocks."""
    texts = []
    for block in tree.blocks:
        holder = block.holder
        text = block.text(holder.marks)
        texts.append(text)
        holder.chars += len(text)
        if any(linked for _, _, linked in block.runs):
            inside = "".join(t for e, t, linked in block.runs if linked and e.marks <= holder.marks)
            holder.links += min(len(" ".join(html.unescape(inside).split())), len(text))
        points = points_of(text)
        if not points:
            continue
        to = holder.parent if holder.tag in PARAGRAPH and holder.parent and not holder.marked else holder
        home, owed = to.home, points
        for share in SHARES:
            to.points += points * share
            if to is home:
                owed = points * (1 - share)
            if to.marked or to.parent is None:
                break
            to = to.parent
        if home is not None:
            home.points += owed
    for e in reversed(tree.elements):
        if e.parent and not e.marked:  # what is marked is left out of what is around it
            e.parent.chars += e.chars
            e.parent.links += e.links
    return texts


def best_of(elements: list[Element]) -> Element:
    """The element with the best score, of equal ones the first. Where that is none, or too little in marked elements alone,
    the article or main element with most text, else the page."""
    best = max(elements, key=lambda e: (e.score(), -e.order))
    if best.score() > 0 and not best.marks:
        return best
    whole = max((e for e in elements if e.tag in WHOLE and not e.marks and e.chars), key=lambda e: (e.chars, -e.order), default=None)
    return whole or (best if best.points >= LEAST_MARKED and best.score() > 0 else elements[0])


def extract(page: str) -> str:
    """The blocks of the main text, a line each."""
    tree = Tree(page)
    if not tree.blocks:
        return ""
    texts = weigh(tree)
    best = best_of(tree.elements)
    kept = {best}
    if best.parent is not None:
        least = max(10.0, best.score() / 5)
        for e in tree.elements:
            if e.parent is best.parent and e is not best and not e.marked and e.chars:
                linked = e.links / e.chars
                if e.score() >= least or linked < 0.25 and (e.tag == "p" and e.chars > 80 or e.tag in HEADING and e.order < best.order):
                    kept.add(e)
    inside = [False] * len(tree.elements)
    for e in tree.elements:
        inside[e.order] = e in kept or bool(e.parent and inside[e.parent.order] and not e.marked)
    return "\n".join(text for block, text in zip(tree.blocks, texts, strict=True) if text and inside[block.holder.order])


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, pages in shared.chunks(batches, "html"):
        texts = [extract(p.as_py()) for p in pages]
        yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def main_texts(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", content: str = "html") -> DataFrame:
    """page_id, url, text, n_chars (code points) of every row. Defined results: null and empty pages, and pages without text
    outside marked elements and with little inside them, have an empty text; text without markup is one block; null ids and
    urls stay null; repeated rows stay; of equal scores the element that begins first is taken; an empty table gives no rows;
    other columns are ignored; pages of any length are read whole, in time that grows with the length."""
    shared.bounded_batches(pages.sparkSession)
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(content).cast("string").alias("html"))
    return rows.mapInArrow(_run, "page_id long, url string, text string, n_chars long")
