"""Main text of web pages: parser events, text-to-tag ratios, smoothed clusters."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm.common import read, slices, texts

BLOCKS = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
#: Elements whose content is no text of the page.
OUTSIDE = frozenset("head script style noscript template button select textarea input iframe object svg canvas audio video".split())
#: Elements that hold boilerplate; a form or header does not if most of the page's text is in it.
ASIDE = frozenset("nav footer aside menu dialog".split())
WRAPPERS = frozenset("header form".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Parts of a class, id or role that mark boilerplate, and parts that may stand beside them.
MARKS = frozenset("ad ads advert adverts advertisement advertising alert alertdialog banner breadcrumb breadcrumbs comment comments complementary contentinfo cookie cookies consent dialog disclaimer discussion disqus footer form header login masthead menu modal nav navbar navigation newsletter notice notices notification pagination popup promo promotion related replies reply respond search share sharing sidebar social sponsor sponsored subscribe subscription teaser toolbar topbar widget widgets giscus utterances livefyre commento isso hyvor graphcomment".split())
BESIDE = frozenset("area articles bar block bottom box buttons column container content global group holder icons inner item items left links list main message outer page pane panel posts primary right section site slot stories the thread top unit wrap wrapper".split())
#: Last parts that mark boilerplate beside any other, but for the words that deny it.
READERS, DENIALS = frozenset("comments replies".split()), frozenset("no not without has with hide hidden disable disabled allow closed".split())
#: Who writes what readers write, and what that is called when it isn't comments.
PEOPLE, OPINIONS = frozenset("user users customer customers reader readers visitor visitors guest guests member members".split()), frozenset("review reviews opinion opinions feedback ratings".split())
#: A paragraph tag is closed by these when they begin.
ENDS_P = BLOCKS - {"br", "body", "html", "head", "title", "option", "caption", "tbody", "td", "tfoot", "th", "thead", "tr"}
#: Elements that may hold an article; paragraphs, headings, lists and tables are parts of one.
CONTAINERS = frozenset("article body center details div fieldset html main section".split())
#: What stands between paragraphs as a part of their text, unless it holds most of the page.
PARTS = frozenset("table ul ol dl blockquote figure pre".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_SPLIT = re.compile(r"[^a-z]+")
#: Width of the smoothing in lines; the share of the threshold that lines next to a cluster need.
SMOOTH, NEXT = 1.0, 0.5
#: What an element named for it adds to its lines' scores, what the score of lines outside it is multiplied by, and what a heading's is raised by.
INSIDE, ELSEWHERE, HEADING = 1.5, 0.3, 1.0


@lru_cache(65536)
def is_marked(value: str) -> bool:
    """Whether a class, id or role has a name that, taken whole, stands for boilerplate: `cookie-notice`, but not `notice-board`."""
    for name in value.lower().split():
        parts = {x for x in _SPLIT.split(name) if x}
        if parts and parts <= MARKS | BESIDE and parts & MARKS or (READERS & parts or PEOPLE & parts and OPINIONS & parts) and not DENIALS & parts:
            return True
    return False


class Lines(HTMLParser):
    """Turns events into lines: text, tags since the line before, links' characters, and the innermost open element.

    Elements are numbered as they open, from 1; 0 is the page. A parent's number
    is less than those of what it holds, so sums go up and inherited properties
    come down in one pass over the numbers, however deep elements nest.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, int]] = []  # name, whether its text is none of the page's, number
        self.names: Counter = Counter()  # of open elements
        self.barred = 0
        self.links = 0
        self.lines: list[tuple[str, int, int, int]] = []
        self.parts: list[str] = []
        self.tags = 0
        self.linked = 0
        self.parent = [0]
        self.roots: set[int] = set()
        self.containers: set[int] = set()
        self.pieces: set[int] = set()
        self.marked: set[int] = set()
        self.aside: set[int] = set()
        self.headings: set[int] = set()

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.lines.append((text, self.tags, self.linked, self.open[-1][2] if self.open else 0))
            self.tags = self.linked = 0
        self.parts.clear()

    def pop(self) -> None:
        tag, bars, _ = self.open.pop()
        self.names[tag] -= 1
        self.barred -= bars
        self.links -= tag == "a"

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag in BLOCKS:
            self.flush()
        if tag in ENDS_P and self.names["p"]:
            while self.open and self.open[-1][0] not in BLOCKS - {"p"}:
                ended = self.open[-1][0] == "p"
                self.pop()
                if ended:
                    break
        if tag in VOID:
            return
        bars, marked = tag in OUTSIDE, tag in WRAPPERS and not (tag == "header" and (self.names["article"] or self.names["main"]))
        if attrs and tag not in ("html", "body"):
            for name, value in attrs:
                if name in ("class", "id", "role") and value and is_marked(value):
                    marked = True
                elif name == "hidden" or name == "aria-hidden" and value == "true":
                    bars = True
        number = len(self.parent)
        self.parent.append(self.open[-1][2] if self.open else 0)
        self.open.append((tag, bars, number))
        self.names[tag] += 1
        self.barred += bars
        self.links += tag == "a"
        if marked:
            self.marked.add(number)
        if tag in ASIDE:
            self.aside.add(number)
        if tag in ("article", "main"):
            self.roots.add(number)
        if tag in CONTAINERS:
            self.containers.add(number)
        if tag in PARTS:
            self.pieces.add(number)
        if tag in HEADINGS:
            self.headings.add(number)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCKS:
            self.flush()
        if not self.names[tag]:
            return
        if tag not in BLOCKS and tag not in OUTSIDE:
            # An inline tag's end doesn't close the blocks around it.
            for name, *_ in reversed(self.open):
                if name == tag:
                    break
                if name in BLOCKS:
                    return
        while True:
            last = self.open[-1][0]
            self.pop()
            if last == tag:
                break

    def handle_data(self, data: str) -> None:
        if self.barred:
            return
        self.parts.append(data)
        if self.links:
            self.linked += len(data)

    def within(self, some: set[int]) -> list[int]:
        """For each element, the innermost one of `some` that it is or lies in; 0 if there is none."""
        out = [0] * len(self.parent)
        for k in range(1, len(out)):
            out[k] = k if k in some else out[self.parent[k]]
        return out

    def masses(self, lines: list[int]) -> list[int]:
        """For each element, the characters outside links of those of the lines that lie in it."""
        out = [0] * len(self.parent)
        for i in lines:
            text, _, linked, k = self.lines[i]
            out[k] += max(0, len(text) - linked)
        for k in range(len(out) - 1, 0, -1):
            out[self.parent[k]] += out[k]
        return out


def smoothed(ratios: np.ndarray, sigma: float = SMOOTH) -> np.ndarray:
    reach = max(1, int(np.ceil(2 * sigma)))
    kernel = np.exp(-(np.arange(-reach, reach + 1) ** 2) / (2 * sigma**2))
    padded = np.pad(ratios, reach, mode="edge")
    return np.convolve(padded, kernel / kernel.sum(), mode="valid")


def barred(page: Lines) -> list[bool]:
    """Whether each line is boilerplate by the names of its elements.

    A mark is void if its element holds four times the text of all free lines,
    and no article or main has any. A void mark frees that much, so there are few.
    """
    aside, rooted = page.within(page.aside), page.within(page.roots)
    lifted: set[int] = set()
    while True:
        # Of each element: how many marks are on it and around it, and one of them.
        count, one = [0] * len(page.parent), [0] * len(page.parent)
        for k in range(1, len(count)):
            up = page.parent[k]
            own = k in page.marked and k not in lifted
            count[k], one[k] = count[up] + own, k if own else one[up]
        mass: Counter = Counter()
        named = False
        for text, _, linked, k in page.lines:
            if count[k] <= 1 and not aside[k]:
                mass[one[k]] += max(0, len(text) - linked)
                named |= not count[k] and rooted[k] > 0
        free = mass.pop(0, 0)
        k, most = max(mass.items(), key=lambda x: (x[1], -x[0]), default=(0, 0))
        if named or most <= 4 * free:
            return [count[k] > 0 or aside[k] > 0 for *_, k in page.lines]
        lifted.add(k)


def hinted(page: Lines, free: list[int]) -> set[int]:
    """Elements named article or main, siblings together, if they hold half of the free text; of nested ones the inner, if those hold nearly all."""
    mass = page.masses(free)
    roots = {k for k in page.roots if mass[k]}
    outer = page.within(roots)
    inner: Counter = Counter()
    for k in roots:
        inner[outer[page.parent[k]]] += mass[k]
    if 2 * inner[0] < mass[0] or not roots:
        return set()
    return {k for k in roots if not inner[k] or inner[k] < 0.9 * mass[k]}


def homes(page: Lines, free: list[int]) -> tuple[list[int], list[int]]:
    """For each element, the container that it lies in; and the one that its text belongs to, which for tables, lists and the like is the one around them."""
    mass = page.masses(free)
    home, text_of = page.within(page.containers), [0] * len(page.parent)
    inside = [False] * len(page.parent)
    for k in range(1, len(text_of)):
        up = page.parent[k]
        inside[k] = inside[up] or k in page.pieces and 2 * mass[k] <= mass[0]
        text_of[k] = k if k in page.containers and not inside[k] else text_of[up]
    return home, text_of


def main_text(html: str) -> str:
    """The article of a page; empty if nothing on it is content.

    A line's score is the logarithm of its text-to-tag ratio, without text in
    links; marked elements have none, and elements named article or main add to
    theirs. Smoothed scores above their standard deviation make clusters.
    Lines next to a cluster in its container, and headings right before it,
    join it if their smoothed score is not far below. So do tables, lists and
    other lines of a container of whose text the clusters have most: an article
    has short lines, too. Time is in proportion to the page's tags and characters.
    """
    page = Lines()
    page.feed(html)
    page.close()
    page.flush()
    lines = page.lines
    bars = barred(page)
    free = [i for i, b in enumerate(bars) if not b]
    if not free:
        return ""
    scores = np.array([0.0 if b else np.log1p(max(0, len(text) - linked) / max(1, tags)) for (text, tags, linked, _), b in zip(lines, bars, strict=True)])
    heading = page.within(page.headings)
    for i in free:
        if scores[i] and heading[lines[i][3]]:
            scores[i] += HEADING
    roots = hinted(page, free)
    rooted = page.within(roots)
    for i in free if roots else ():
        scores[i] = scores[i] + INSIDE if rooted[lines[i][3]] else scores[i] * ELSEWHERE
    level = smoothed(scores)
    high = min(float(level.std()), float(level.max()))
    chosen = {i for i in free if level[i] >= high} or set(free)
    home, text_of = homes(page, free)
    # Along free lines in both directions, so that a line joins one that has joined.
    for order in (free, free[::-1]):
        for before, i in zip(order, order[1:]):
            near = home[lines[i][3]] == home[lines[before][3]] or order is not free and heading[lines[i][3]]
            if before in chosen and near and level[i] >= NEXT * high:
                chosen.add(i)
    whole, taken = defaultdict(int), defaultdict(int)
    for i in free:
        text, _, linked, k = lines[i]
        whole[text_of[k]] += max(0, len(text) - linked)
        if i in chosen:
            taken[text_of[k]] += max(0, len(text) - linked)
    chosen.update(i for i in free if 2 * taken[text_of[lines[i][3]]] > whole[text_of[lines[i][3]]])
    return " ".join(lines[i][0] for i in sorted(chosen))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "html"):
        found = [main_text(x) for x in texts(batch, "html")]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each row of `pages`.

    A null or empty html, and a page without content, give an empty text.
    Unclosed and stray tags are taken as browsers take them, as far as blocks
    go. A page of any length is parsed whole, in a batch of its own. Repeated
    rows are each returned; an empty table gives no rows; extra columns are
    ignored, whatever their names.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return pages.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages"))
