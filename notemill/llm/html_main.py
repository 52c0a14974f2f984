"""Main-text extraction from raw web pages (operator 9).

The standard library's parser streams a page's events. They are cut into lines at block elements, and each line
has its text, its number of tags and the open elements around it. The text-to-tag ratio of the lines is smoothed
by a Gaussian; lines above a threshold on it that follow each other are a cluster. The heaviest clusters, those of LIGHT of the heaviest one's text at least, choose the element that holds
the article. Every line of that element is then kept, however short, but for those under elements that are
menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles or reader comments.

Elements are told by their names, and by whole words of class, id and role: `site-header` is a header, `has-sidebar`, `comments-open` and `no-ads` say something of an article, and
what `article-header` and an article's own header have of headlines stays. A form, or an element that only its class or id tells, is never left out if it has MOST of the page's text, unless it is for
comments.

Defined results: null or empty html, or a page without content, gives the empty text and n_chars 0; null ids and urls stay;
repeated rows give repeated results; columns other than page_id, url and html are ignored; pages of any
length are read whole. Of equally heavy elements the first on the page wins.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Elements that never belong to an article's text.
SKIPPED = frozenset("nav header footer aside script style noscript template iframe object svg math canvas button select option textarea input label fieldset dialog menu head title audio video map".split())
#: Words in class, id or role that mark an element as none of the article's, and those of them that are for readers' comments.
MARKS = frozenset(
    """nav navigation navbar menu menubar header masthead topbar footer colophon contentinfo sidebar complementary rail ad ads adv advert adverts
    advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay toast
    comment comments commentlist disqus respond reply replies discussion form search newsletter subscribe signup login share sharing social
    related recommended recommendations breadcrumb breadcrumbs pagination pager widget skip hidden toolbar""".split()
)
COMMENTS = frozenset("comment comments commentlist disqus respond reply replies discussion".split())
#: First and last words of names that tell a state or a layout, and first words of names for parts of an article.
BEFORE, AFTER = frozenset("has no with without is not show hide js wp supports".split()), frozenset("open opened closed on off enabled disabled active layout template page".split())
ARTICLES = frozenset("article entry post story content".split())
BLOCKS = frozenset(
    """address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6
    head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td textarea tfoot th thead title tr ul""".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that may hold an article.
HOLDERS = frozenset("article main section div td body html center".split())
#: An open paragraph ends where one of these begins; other elements end only their own kind.
CLOSES_P = BLOCKS - {"br", "body", "html", "head", "option", "optgroup", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "title"}
SELF_CLOSING = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

#: Width of the Gaussian in lines, and the part of the mean smoothed ratio that a content line must reach.
SIGMA, LEVEL = 1.0, 0.5
#: The part of the heaviest cluster's text that a cluster must have to count, and the part of the page's text with which no element is left out for its class.
LIGHT, MOST = 0.1, 0.5
_WORDS = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")
# What an element is to the article: part of it; never; not, going by its class; not, and for comments; a header whose headlines stay.
PART, NEVER, NAMED, TALK, HEADER = range(5)


def _named(attrs: list[tuple[str, str | None]]) -> int:
    """What an element's attributes tell of it."""
    found = PART
    for name, value in attrs:
        if name in ("class", "id", "role") and value:
            for token in value.split():
                words = [w.lower() for w in _WORDS.findall(token)]
                marks = MARKS.intersection(words)
                if not marks or len(words) > 1 and (words[0] in BEFORE or words[-1] in AFTER):
                    continue
                if marks & COMMENTS:
                    return TALK
                if marks == {"header"} and words[0] in ARTICLES:
                    found = max(found, HEADER)
                else:
                    found = NAMED
        elif name == "hidden" or (name == "aria-hidden" and value == "true"):
            return NEVER
    return found


class _Lines(HTMLParser):
    """Collects a page's lines: texts, numbers of tags, and the node that each is under. Nodes are elements that may hold an article or don't belong to one."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, int]] = [("", 0)]  # name, node
        self.nodes: list[tuple[str, int, int]] = [("", -1, PART)]  # name, parent, what it is
        self.texts: list[str] = []
        self.tags: list[int] = []
        self.under: list[int] = []
        self.parts: list[str] = []
        self.n_tags = 0

    def end_line(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            self.parts = []
            if text:
                self.texts.append(text)
                self.tags.append(self.n_tags)
                self.under.append(self.stack[-1][1])
                self.n_tags = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        stack = self.stack
        if tag in BLOCKS:
            self.end_line()
            if tag in CLOSES_P:
                for at in range(len(stack) - 1, 0, -1):
                    if stack[at][0] == "p":
                        del stack[at:]
                        break
                    if stack[at][0] in HOLDERS:
                        break
            if tag in SELF_CLOSING:
                for at in range(len(stack) - 1, 0, -1):
                    if stack[at][0] in SELF_CLOSING[tag]:
                        break
                    if stack[at][0] == tag:
                        del stack[at:]
                        break
        self.n_tags += 1
        if tag in VOID:
            return
        node = stack[-1][1]
        if tag in HEADINGS and self.nodes[node][2] == HEADER:
            node = self.nodes[node][1]  # a headline is beside the header that it is in
        else:
            what = NEVER if tag in SKIPPED else PART
            if tag == "header" and self._in_article(node):
                what = HEADER
            elif tag == "form":
                what = NAMED
            if what in (PART, NAMED) and attrs and tag not in ("html", "body"):
                what = max(what, _named(attrs), key=(PART, HEADER, NAMED, TALK, NEVER).index)
            if what != PART or tag in HOLDERS:
                self.nodes.append((tag, node, what))
                node = len(self.nodes) - 1
        stack.append((tag, node))

    def _in_article(self, node: int) -> bool:
        while node > 0:
            name, node, _ = self.nodes[node]
            if name == "article":
                return True
        return False

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS:
            self.end_line()
        self.n_tags += 1

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.end_line()
        self.n_tags += 1
        stack = self.stack
        for at in range(len(stack) - 1, 0, -1):
            if stack[at][0] == tag:
                del stack[at:]
                return
            if tag == "p" and stack[at][0] in HOLDERS:
                return

    def handle_data(self, data: str) -> None:
        self.parts.append(data)

    def parse_marked_section(self, i: int, report: int = 1) -> int:  # odd declarations are skipped, not fatal
        end = self.rawdata.find(">", i)
        return end + 1 if end >= 0 else -1


def _kernel(sigma: float) -> np.ndarray:
    x = np.arange(-int(3 * sigma), int(3 * sigma) + 1)
    k = np.exp(-(x**2) / (2 * sigma**2))
    return k / k.sum()


def smoothed(sizes: np.ndarray, tags: np.ndarray, on: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """The lines' text-to-tag ratios (0 where not on) under a Gaussian."""
    kernel = _kernel(sigma)
    return np.convolve(np.where(on, sizes / np.maximum(1, tags), 0.0), kernel)[len(kernel) // 2 :][: len(sizes)]


def clusters(content: np.ndarray, sizes: np.ndarray, light: float = LIGHT) -> np.ndarray:
    """Which lines are in a cluster (a run of content lines) that has light of the heaviest one's text at least."""
    begins = content & ~np.append(False, content[:-1])
    of = np.cumsum(begins) * content  # 0: none
    mass = np.bincount(of, sizes)
    mass[0] = 0
    return content & (mass[of] >= light * mass.max())


def main_text(html: str | None, sigma: float = SIGMA, level: float = LEVEL) -> str:
    """The article's text: white space within a block as one space, blocks joined by one newline."""
    if not html:
        return ""
    page = _Lines()
    page.feed(html)
    if re.match(r"<[a-zA-Z/!?]", page.rawdata):  # a tag or comment that the page's end cut off
        page.rawdata = ""
    page.close()
    page.end_line()
    texts, under, nodes = page.texts, np.array(page.under, np.int64), page.nodes
    if not texts:
        return ""
    sizes, tags = np.fromiter(map(len, texts), np.float64, len(texts)), np.array(page.tags, np.float64)

    def outside(by_name: list[bool]) -> np.ndarray:
        """For each node, whether it or one around it is none of the article's; a node comes after its parent."""
        out = np.zeros(len(nodes), bool)
        for k, (_, parent, what) in enumerate(nodes):
            out[k] = (parent >= 0 and out[parent]) or what == NEVER or (what != PART and by_name[k])
        return out

    def mass_of(lines: np.ndarray) -> np.ndarray:
        """The text of such lines under each node."""
        mass = np.bincount(under[lines], sizes[lines], len(nodes))
        for k in range(len(nodes) - 1, 0, -1):
            mass[nodes[k][1]] += mass[k]
        return mass

    own = mass_of(~outside([False] * len(nodes))[under])
    out = outside([what != NAMED or own[k] < MOST * own[0] for k, (_, _, what) in enumerate(nodes)])
    allowed = ~out[under]
    smooth = smoothed(sizes, tags, allowed, sigma)
    content = allowed & (smooth >= level * smooth.mean())
    mass = mass_of(clusters(content, sizes) if content.any() else allowed)
    if mass[0] == 0:
        return ""
    articles = [k for k, (name, _, _) in enumerate(nodes) if name in ("article", "main") and mass[k] >= 0.2 * mass[0]]
    if articles:
        chosen = max(articles, key=lambda k: (mass[k], nodes[k][0] == "article", -k))
        inner = [k for k in articles if nodes[k][0] == "article" and mass[k] >= 0.8 * mass[chosen]]
        chosen = inner[0] if inner and nodes[chosen][0] == "main" else chosen
    else:
        chosen = max(k for k in range(len(nodes)) if mass[k] >= 0.9 * mass[0])
    inside = [False] * len(nodes)
    inside[chosen] = True
    for k in range(chosen + 1, len(nodes)):
        inside[k] = inside[nodes[k][1]]
    return "\n".join(t for t, k in zip(texts, page.under, strict=True) if inside[k] and not out[k])


def extract_main(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: page_id, url, text, n_chars."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_text(html.as_py()) for html in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], schema=schema)

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op9_html_main(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query: the main text of every page."""
    return extract_main(table(spark, sf_dir, "pages"))
