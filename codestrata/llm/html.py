"""Main text of web pages: parser events become lines, and lines rich in text against their tags are the content.

The standard library's parser walks a page once.  A line is the text between two block boundaries, with its number of
tags and the share of its characters that stand in links.  Text-to-tag ratios of the lines are smoothed with a Gaussian
and divided into two clusters (two means, on a log scale).  The content region is then the smallest element that holds
nearly all of the text of the upper cluster: an article or main element where the page has one with such text.
All lines of the region belong to the text, short ones as well, but for those in elements that are not the article:
navigation, page headers, footers, sidebars, notices, adverts, forms, scripts, styles, comments of readers, and runs of links.

Defined results
* A null or empty page gives an empty text, as does one without any text outside such elements.  One row for each page;
  repeated rows give repeated results, and no other row matters for a result.
* White space, also that of character references, becomes one space; blocks are trimmed and joined in page order.  Markup
  that is never closed ends with the element around it, a comment with the page.  Of several regions with equal text the first counts.
* Memory is in proportion to the longest page of a batch: its lines are held once.  Nothing is cut off.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.llm.tables import map_batches, table

SIGMA = 1.0  # lines
MOST_LINKS = 0.5  # of a list's or a line's characters
NEARLY_ALL = 0.9  # of the upper cluster's characters stand in the content region

# elements of the language, by what they do to text
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
HEAD = set("head title style script link meta base noscript template".split())
SILENT = set("script style noscript template head title svg math iframe object canvas audio video map".split())
FORMS = set("form button select textarea input option optgroup datalist label fieldset legend output".split())
ASIDE = set("nav aside footer menu dialog".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
PROSE = {"p", "li", "dd", "dt", "pre", "blockquote", "td", "figcaption"} | HEADINGS
CONTAINERS = {"", "html", "body", "div", "section", "td", "center", "article", "main"}
ENDS = {  # an opening tag ends these open elements, up to the elements that hold them
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select", "datalist"}),
}
#: Words of class, id and role that mark what is not the article.
MARKS = set(
    "nav navbar navigation menu submenu breadcrumb breadcrumbs pagination pager toc skip "
    "header masthead banner topbar footer colophon copyright legal "
    "sidebar aside widget widgets rail related recommended recommendations trending popular tagcloud outbrain taboola "
    "notice notices notification notifications alert cookie cookies consent gdpr disclaimer popup modal overlay paywall "
    "toast tooltip ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion promoted "
    "form search searchbox login signup signin subscribe subscription newsletter share sharing social follow "
    "comment comments commentlist respond reply replies discussion disqus feedback "
    "complementary contentinfo alertdialog status hidden".split()
)
#: Of these, words that an article's own head may carry.
HEADS = {"header", "masthead", "banner"}
#: Words that turn such a word into its opposite, as in "has-sidebar".
TURNED = {"no", "without", "has", "with"}
CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def marked(attributes: list[tuple[str, str | None]], inside: bool) -> bool:
    """Whether class, id, role or visibility say that an element is not the article; inside: it stands in one."""
    marks = MARKS - HEADS if inside else MARKS
    for name, value in attributes:
        value = value or ""
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and UNSEEN.search(value)):
            return True
        if name == "itemprop" and value == "comment" or name == "aria-label" and value.lower() in marks:
            return True
        if name in ("class", "id", "role"):
            for part in value.split():
                words = [w.rstrip("0123456789") for w in re.split("[^a-z0-9]+", CAMEL.sub("-", part).lower())]
                words += [a + b for a, b in zip(words, words[1:])]
                if not marks.isdisjoint(words) and TURNED.isdisjoint(words):
                    return True
    return False


IN, MARKED, BARRED = 0, 1, 2  # part of the article as far as is known; not so by its class; not so by its kind


@dataclass
class Element:
    tag: str
    parent: int
    out: int  # IN, or why it or an element around it is not the article
    root: bool  # an article or main element
    inside: bool  # it is such an element or stands in one
    first: int = 0  # lines [first, last) stand in it
    last: int = 0


@dataclass
class Line:
    text: str
    tags: int
    linked: int  # characters in links
    out: bool
    element: int  # the block that holds it


@dataclass
class Page(HTMLParser):
    """Lines and elements of one page, in page order."""

    elements: list[Element] = field(default_factory=list)
    lines: list[Line] = field(default_factory=list)

    def __post_init__(self) -> None:
        HTMLParser.__init__(self, convert_charrefs=True)
        self.elements.append(Element("", -1, IN, False, False))
        self.open = [0]  # elements that are open, from the page inwards
        self.parts: list[str] = []  # the text of the line so far
        self.tags = self.linked = self.silent = self.links = 0

    def updatepos(self, i: int, j: int) -> int:
        """Line numbers of the source are not needed."""
        return j

    def end_line(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            block = next(e for e in reversed(self.open) if self.elements[e].tag not in INLINE)
            out = self.elements[self.open[-1]].out != IN
            self.lines.append(Line(text, self.tags, min(self.linked, len(text)), out, block))
            self.tags = 0
        self.parts, self.linked = [], 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag in VOID:
            if tag == "br":
                self.parts.append("\n")
            elif tag == "hr":
                self.close_before(tag)
                self.end_line()
            return
        above = self.elements[self.open[-1]]
        mark = bool(attrs) and above.out == IN and tag not in ("html", "body") and marked(attrs, above.inside)
        if tag not in INLINE:
            self.close_before(tag)
            above = self.elements[self.open[-1]]
        if tag not in INLINE or mark:
            self.end_line()
        whole = tag == "main" or ("role", "main") in attrs
        if tag in SILENT or tag in FORMS or tag in ASIDE or (tag == "header" and not above.inside):
            out = BARRED
        elif whole and above.out != BARRED:
            out = IN  # classes of what is around it speak of the layout
        else:
            out = above.out or (MARKED if mark else IN)
        root = out == IN and (whole or tag == "article" or ("itemprop", "articleBody") in attrs)
        out = max(out, BARRED if above.out == BARRED else IN)
        self.elements.append(Element(tag, self.open[-1], out, root, above.inside or root, len(self.lines)))
        self.open.append(len(self.elements) - 1)
        self.silent += tag in SILENT
        self.links += tag == "a"

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        """Like an opening tag, as in all of HTML but drawings and the like."""
        self.handle_starttag(tag, attrs)
        if self.silent and tag not in VOID:
            self.handle_endtag(tag)

    def close_before(self, tag: str) -> None:
        """Ends elements that an opening block tag ends by itself."""
        if tag not in HEAD:
            for at, e in enumerate(self.open[:4]):
                if self.elements[e].tag == "head":
                    self.close_to(at)
                    break
        ended, holders = ENDS.get(tag, ({"p"}, set()))
        for at in range(len(self.open) - 1, 0, -1):
            name = self.elements[self.open[at]].tag
            if name in ended:
                self.close_to(at)
                if tag not in ENDS:
                    return
            elif name in holders or (tag not in ENDS and name not in INLINE):
                return

    def close_to(self, at: int) -> None:
        """Ends the open elements from the at-th one inwards."""
        self.end_line()
        for e in self.open[at:]:
            self.forget(e)
        del self.open[at:]

    def forget(self, e: int) -> None:
        element = self.elements[e]
        element.last = len(self.lines)
        self.silent -= element.tag in SILENT
        self.links -= element.tag == "a"

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        for at in range(len(self.open) - 1, 0, -1):
            e = self.open[at]
            name = self.elements[e].tag
            if name == tag:
                if tag in INLINE and self.elements[e].out == IN:
                    self.forget(e)
                    del self.open[at]
                else:
                    self.close_to(at)
                return
            if tag in INLINE and name not in INLINE:
                return  # an inline element ends with the block around it
        if tag == "p":
            self.end_line()

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.parts.append(data)
            if self.links:
                self.linked += len(data.strip())

    def finish(self) -> None:
        if self.rawdata.startswith("<!--"):
            self.rawdata = ""  # a comment that is never closed goes to the end of the page
        self.close()
        self.close_to(1)
        self.elements[0].last = len(self.lines)


def smoothed(ratio: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """A Gaussian over neighbouring lines; at the ends over those that are there."""
    reach = int(np.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    total = np.convolve(ratio, kernel)[reach : reach + len(ratio)]
    return total / np.convolve(np.ones(len(ratio)), kernel)[reach : reach + len(ratio)]


def threshold(values: np.ndarray) -> float:
    """The boundary of two clusters: halfway between their means, once they no longer move."""
    low, high = float(values.min()), float(values.max())
    for _ in range(100):
        cut = (low + high) / 2
        upper = values >= cut
        if upper.all() or not upper.any():
            return cut
        moved = float(values[~upper].mean()), float(values[upper].mean())
        if moved == (low, high):
            break
        low, high = moved
    return (low + high) / 2


def linked_lists(page: Page, out: np.ndarray, sizes: np.ndarray, linked: np.ndarray) -> np.ndarray:
    """Lines of elements that consist of links, outside of articles: menus that don't say so."""
    found = np.zeros(len(out), bool)
    size, link = (np.concatenate([[0], np.cumsum(np.where(out, 0, v))]) for v in (sizes, linked))
    for e in page.elements:
        if not e.inside and e.last > e.first and link[e.last] - link[e.first] > MOST_LINKS * (size[e.last] - size[e.first]):
            found[e.first : e.last] = True
    return found


def region(page: Page, upper: np.ndarray, out: np.ndarray, sizes: np.ndarray) -> tuple[int, int]:
    """The first line of the content region and the one after its last."""
    elements, lines = page.elements, page.lines

    def held(mask: np.ndarray) -> list[float]:
        total = np.concatenate([[0.0], np.cumsum(np.where(mask, sizes, 0.0))])
        return [float(total[e.last] - total[e.first]) for e in elements]

    rich, any_text = held(upper), held(~out)
    roots = [i for i, e in enumerate(elements) if e.root and any_text[i] > 0]
    if roots:
        best = max(roots, key=lambda i: (rich[i], any_text[i], -i))
        inner = [i for i in roots if i > best and elements[i].last <= elements[best].last]
        dense = [i for i in inner if any_text[i] >= NEARLY_ALL * any_text[best]]
        best = dense[-1] if dense else best
        first, last = elements[best].first, elements[best].last
    else:
        # elements come outermost first, and no two beside each other can both hold nearly all
        best = [i for i, e in enumerate(elements) if e.tag in CONTAINERS and rich[i] >= NEARLY_ALL * rich[0]][-1]
        first, last = elements[best].first, elements[best].last
        # text at either end belongs to it if it is rich, or prose beside rich text
        beside = {elements[lines[i].element].parent for i in np.flatnonzero(upper)}

        def belongs(i: int) -> bool:
            block = elements[lines[i].element]
            return not out[i] and (upper[i] or (block.tag in PROSE and block.parent in beside))

        kept = [i for i in range(first, last) if belongs(i)]
        first, last = (kept[0], kept[-1] + 1) if kept else (first, last)
    tags = [elements[line.element].tag for line in lines]
    if first and "h1" not in tags[first:last] and tags[first - 1] == "h1" and not out[first - 1]:
        first -= 1  # the title right above
    return first, last


def main_text(html: str | None) -> str:
    """The text of the article of one page."""
    page = Page()
    page.feed(html or "")
    page.finish()
    sizes = np.array([len(line.text) for line in page.lines], float)
    linked = np.array([line.linked for line in page.lines], float)
    out = np.array([line.out for line in page.lines], bool)
    out |= linked_lists(page, out, sizes, linked)
    if out.all():
        return ""
    tags = np.array([max(line.tags, 1) for line in page.lines], float)
    ratio = smoothed(np.where(out, 0.0, np.log1p(np.maximum(sizes - linked, 0) / tags)))
    upper = ~out & (ratio >= threshold(ratio[~out]))
    first, last = region(page, upper if upper.any() else ~out, out, sizes)
    return " ".join(line.text for i, line in enumerate(page.lines[first:last], first) if not out[i])


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """pages with a column main_text instead of the html; the other columns are kept as they are."""
    others = [c for c in pages.columns if c != html_col]
    packed = pages.select(F.struct(*(pages[c] for c in others)).alias("row"), pages[html_col].alias("html"))
    kind = packed.schema["row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array((main_text(h.as_py()) for h in batch["html"]), pa.string())
            yield pa.RecordBatch.from_arrays([batch["row"], texts], ["row", "main_text"])

    found = map_batches(packed, run, f"row {kind}, main_text string")
    return found.select("row.*", "main_text")


def query(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    found = extract(pages).withColumnRenamed("main_text", "text")
    return found.withColumn("n_chars", F.char_length("text").cast("long"))
