"""Main text of web pages by text-to-tag ratio.

The standard library's parser streams events; they are cut into lines at block elements. A line's ratio is its
text outside links over the tags it took, nothing for lines in menus, headers, footers, sidebars, notices, adverts, forms and
comments, which elements and their class, id and role names tell. The ratios are smoothed by a Gaussian and
clustered by a threshold, a share of their standard deviation: lines above it are content. Content lines choose the regions: their
articles, or their innermost containers where the page has no article. A region's other lines stay, headings and short paragraphs,
but for those that are neither near content by their smoothed ratio nor mostly text outside links.

A form around an article is no form of its own, nor is one around all the text of a page. Of an article's own header the
headings stay. Inside an article a name marks only if all its words do or tell nothing ("cookie-notice", "ad-slot", not "social-good"). On a page without an
article the first and last containers go while they have little text beside the largest (``EDGE`` of its content) and no main heading: a title of a
sidebar, a line of copyright.

Cases: null or empty html, and pages without text, give the empty string. Unclosed or crossed tags, unfinished references and
text without any markup are read as they stand; a comment that never ends hides the rest of the page, a tag that never ends is text. Any length is
parsed whole, in linear time. Repeated rows give repeated
results; other columns are not read; an empty table gives an empty result.
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

from gleaner.llm.common import slices, texts

SIGMA, SPREAD = 1.0, 0.25  # of the smoothing, in lines; share of the standard deviation that a content line must reach

#: Share of the largest container's content under which one at either end of a page without articles is none.
EDGE = 0.2
#: Elements whose text is never shown as part of an article.
_HIDDEN = frozenset("head title script style noscript template svg math iframe object canvas audio video select option button textarea input dialog".split())
_BOILER = frozenset("nav header footer aside form menu".split()) | _HIDDEN
#: Words in class, id or role names that mark the same.
_MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner banners navigation nav navbar menu menus breadcrumb breadcrumbs "
    "sidebar sidebars aside footer foot masthead header topbar toolbar comment comments reply replies respond discussion disqus cookie cookies consent "
    "notice notices alert popup modal overlay newsletter subscribe signup login social share sharing related recommended teaser teasers widget widgets "
    "pagination pager complementary contentinfo search form hidden".split()
)
#: Words in such names that tell nothing.
_NEUTRAL = frozenset("slot box block container wrapper wrap inner outer area panel list item items bar link links unit section group row col column post posts article articles site page main top bottom left right content js is has".split())
_CONTAINERS = frozenset("body article main section div td table ul ol figure details blockquote".split())
_BLOCKS = _CONTAINERS | _BOILER | frozenset("html p h1 h2 h3 h4 h5 h6 li dl dt dd tr th thead tbody tfoot caption pre hr br address fieldset figcaption summary center".split())
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements that end where the next block of their kind begins.
_SELF_ENDING = frozenset("p li dt dd option".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_UNPARSED = re.compile(r"<!--|<(script|style)\b", re.I)
_COMMENT_END = re.compile(r"--!?>")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: How sure it is that an element is no article text: not, a form, a header of an article, else.
_PLAIN, _FORM, _HEADER, _OTHER = range(4)


def marks(value: str, in_article: bool) -> bool:
    """Whether a class, id or role tells of boilerplate."""
    if not in_article:
        return any(w.lower() in _MARKS for w in _NAME.findall(value))
    names = ([w.lower() for w in _NAME.findall(name)] for name in value.split())
    return any(any(w in _MARKS for w in words) and all(w in _MARKS or w in _NEUTRAL for w in words) for words in names)


def finished(html: str) -> str:
    """The page without a comment that never ends, and with what looks like a tag behind the last one as text: the parser would look for their ends again and again."""
    at = 0
    while m := _UNPARSED.search(html, at):
        end = re.compile(f"</{m[1]}", re.I).search(html, m.end()) if m[1] else _COMMENT_END.search(html, m.end())
        if not end:
            html = html if m[1] else html[: m.start()]
            break
        at = end.end()
    last = html.rfind(">") + 1
    return html[:last] + html[last:].replace("<", "&lt;")


class Lines(HTMLParser):
    """Collects (text, tags, characters in links, container, article, boilerplate) of each block of a page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, int, int, int]] = []
        self.titled: set[int] = set()  # containers with a main heading
        self.stack: list[tuple[str, int, int, int]] = [("", 0, 0, _PLAIN)]  # tag, container, article, boilerplate
        self.open: Counter[str] = Counter()
        self.made = self.tags = self.linked = self.anchors = 0
        self.text: list[str] = []

    def cut(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            _, container, article, boiler = self.stack[-1]
            self.lines.append((text, self.tags, self.linked, container, article, boiler))
            self.tags = 0
        self.text, self.linked = [], 0

    def push(self, tag: str, container: int, article: int, boiler: int) -> None:
        self.stack.append((tag, container, article, boiler))
        self.open[tag] += 1

    def pop(self) -> str:
        tag = self.stack.pop()[0]
        self.open[tag] -= 1
        return tag

    def handle_starttag(self, tag: str, attrs: list) -> None:
        block = tag in _BLOCKS
        if block:
            self.cut()
            if self.stack[-1][0] in _SELF_ENDING or tag in _HEADINGS and self.stack[-1][0] in _HEADINGS:
                self.pop()
            if tag in ("body", "main"):  # ends whatever was left open before it
                while self.stack[-1][0] in _BOILER:
                    self.pop()
        self.tags += 1
        if tag == "a":
            self.anchors += 1
        if tag in _VOID:
            return
        _, container, article, boiler = self.stack[-1]
        own = _PLAIN
        if tag in _BOILER:
            own = _FORM if tag == "form" else _HEADER if tag == "header" and article else _OTHER
        elif attrs and tag not in ("html", "body", "main", "article"):
            for name, value in attrs:
                if value and name in ("class", "id", "role") and marks(value, article > 0):
                    own = _OTHER
                elif name == "hidden" or name == "aria-hidden" and value == "true":
                    own = _OTHER
        if tag in _CONTAINERS:
            self.made += 1
            container = self.made
            if tag in ("article", "main"):
                article = self.made
                boiler = _PLAIN if boiler == _FORM else boiler
        if tag in ("h1", "h2"):
            self.titled.add(container)
        if tag in _HEADINGS and boiler == _HEADER and own == _PLAIN:
            self.push(tag, container, article, _PLAIN)
        elif own or tag in _CONTAINERS:
            if not block:
                self.cut()
            self.push(tag, container, article, max(boiler, own))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        block = tag in _BLOCKS
        self.tags += 1
        if tag == "a":
            self.anchors = max(0, self.anchors - 1)
        if self.open[tag]:
            self.cut()
            while self.pop() != tag:
                pass
        elif block:
            self.cut()

    def handle_data(self, data: str) -> None:
        self.text.append(data)
        if self.anchors:
            self.linked += len(data)


def smoothed(x: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing; beyond either end the first or last value goes on."""
    radius = max(1, int(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    return np.convolve(np.pad(x, radius, mode="edge"), kernel / kernel.sum(), mode="valid")


def main_text(html: str | None) -> str:
    if not html:
        return ""
    parser = Lines()
    parser.feed(finished(html))
    parser.close()
    parser.cut()
    lines = parser.lines
    if not lines:
        return ""
    kind = np.array([x[5] for x in lines])
    boiler = kind != _PLAIN
    if boiler.all():  # a form around everything
        boiler = kind != _FORM
    if boiler.all():
        return ""
    free = np.array([max(0, len(x[0]) - x[2]) for x in lines])
    ratio = np.where(boiler, 0.0, free / np.maximum(1, [x[1] for x in lines]))
    level = smoothed(ratio)
    near = level >= SPREAD * level.std()
    content = near & ~boiler & (ratio > 0)
    # lines of a region that are far from content stay where they are mostly text of their own
    kept = ~boiler & (near | (2 * free >= np.array([len(x[0]) for x in lines])))
    articles = {x[4] for x, b in zip(lines, boiler, strict=True) if x[4] and not b}
    place = 4 if articles else 3  # regions compete as articles, else as containers
    sizes: Counter[int] = Counter()
    for x, b, c in zip(lines, boiler, content, strict=True):
        if not b:
            sizes[x[place]] += len(x[0]) if c else 0
    regions = articles or set(sizes)
    chosen = {r for r in regions if sizes[r]}
    if chosen and not articles:
        order = [r for r in dict.fromkeys(x[3] for x in lines) if r in chosen]
        least = EDGE * max(sizes.values())
        for ends in (order, order[::-1]):
            for r in ends:
                if sizes[r] >= least or r in parser.titled:
                    break
                chosen.discard(r)
    if not chosen:  # no line stands out
        whole: Counter[int] = Counter()
        for x, b in zip(lines, boiler, strict=True):
            whole[x[place]] += 0 if b else len(x[0])
        chosen, kept = ({max(sorted(regions), key=whole.__getitem__)} if articles else regions), ~boiler
    return " ".join(x[0] for x, k in zip(lines, kept, strict=True) if k and x[place] in chosen)


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, url, text, n_chars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in slices(big, "html"):
                found = [main_text(h) for h in texts(batch.column(2))]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], [id_col, url_col, "text", "n_chars"])

    id_type = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{url_col}`").alias(url_col), F.col(f"`{html_col}`").alias("html")).mapInArrow(run, f"`{id_col}` {id_type}, `{url_col}` string, text string, n_chars long")
