"""Main text of web pages: parser events, text-to-tag ratios, Gaussian smoothing and a threshold.

A streaming parser turns each page into lines, one per block of text, and leaves out what marks itself as
something else (menus, footers, scripts, adverts, comments). Every line has a ratio of characters to tags; the
ratios are smoothed over neighbouring lines, and lines above a threshold taken from the page itself are content.
Where a page marks its article, that is taken, with the headings right before it. Elsewhere content lines point out the
regions that hold the article; all regions below their common ancestor are taken as a whole, whatever their size, so
headings, short paragraphs and short sections stay. Regions made of links are not. Reader comments and legal notices
are left out whatever their share of the page.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lorewell.llm import batches as B

# fixed values: element names of the markup language, and words by which pages name their side matter
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr".split())
SIDE_TAGS = frozenset(
    "head title script style noscript template nav footer aside form button select textarea svg math iframe object canvas "
    "audio video menu dialog".split())
SIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie "
    "cookies copyright disclaimer disqus footer gdpr header impressum imprint legal login masthead menu modal nav navbar "
    "navigation newsletter notice notices popup privacy promo promotion related reply replies respond search share sharing "
    "sidebar signup social sponsor sponsored subscribe toolbar widget".split())
# words of elements that are never part of an article, however much text they hold
NEVER = frozenset("comment comments disqus replies respond copyright gdpr impressum imprint legal".split())
# words that make a side word the property of a wrapper (with-sidebar), and words that own their header (entry-header)
MODIFIERS = frozenset("with without has have no not is hide show after before under below above behind between off on beside "
                      "open closed enabled disabled allow allowed".split())
OWNERS = frozenset("article content entry main page post section story title text body block hentry".split())
SIDE_ROLES = frozenset("navigation banner complementary contentinfo search form alert dialog menu".split())
ARTICLE = frozenset(("article", "main"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
REGIONS = frozenset("body section div td".split())
CLOSED_BY = {"p": frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main "
                            "nav ol p pre section table ul".split()),
             "li": frozenset(("li",)), "option": frozenset(("option",)), "td": frozenset(("td", "th", "tr")), "tr": frozenset(("tr",))}

_WORDS = re.compile(r"[a-z]+|\d+")


@dataclass
class Line:
    text: str
    tags: int
    region: int
    linked: int = 0  # characters in links
    doubt: int = 0  # the innermost open element that is side matter unless it holds most of the text; 0 for none
    heading: bool = False


class _Lines(HTMLParser):
    """Collects lines; ``side`` counts the open elements that are no part of an article.

    ``above`` has the region around each region; region 0 is the page. ``doubts`` has the doubtful element around each
    doubtful element. Every tag costs the same, however deep the page is nested.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.open: list[tuple[str, bool, int, int]] = []  # tag, side matter, region and doubt before it
        self.count: dict[str, int] = {}  # open elements by tag
        self.blocks: list[int] = []  # places of the open elements that are not inline
        self.side, self.region, self.articles, self.links = 0, 0, 0, 0
        self.above, self.marked = [0], set()
        self.doubt, self.doubts = 0, [0]
        self.headings = 0
        self.parts: list[str] = []
        self.tags, self.linked = 0, 0

    def updatepos(self, i, j):
        """Line numbers are of no use here."""
        return j

    def _is_side(self, tag: str, attrs: list) -> int:
        """2 for side matter, 1 for what is called after side matter, 0 for all others."""
        if tag in SIDE_TAGS or (tag == "header" and not self.articles):
            return 2
        found = 0
        for name, value in attrs:
            if name in ("class", "id") and value and tag not in ("html", "body", "article", "main"):
                found = max(found, self._side_name(value))
            elif name == "role" and value and value.strip().lower() in SIDE_ROLES:
                return 2
            elif name == "hidden" or (name == "aria-hidden" and value == "true"):
                return 2
        return found

    def _side_name(self, value: str) -> int:
        """A name of side words only is the element's role; one with other words may be that of a wrapper."""
        found = 0
        names = [_WORDS.findall(x) for x in value.lower().split()]
        for words in names:
            side = SIDE_WORDS.intersection(words)
            if not side or MODIFIERS.intersection(words):
                continue
            if side == {"header"} and (self.articles or OWNERS.intersection(words)):
                continue
            if NEVER.intersection(words):
                return 2
            whole = all(w in SIDE_WORDS or w.isdigit() for w in words)
            found = max(found, 2 if whole else 1)
        if found and any(x and OWNERS.issuperset(x) for x in names):
            return 1  # another of its names says that it is content
        return found

    def _flush(self):
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.lines.append(Line(text, self.tags, self.region, min(self.linked, len(text)), self.doubt, self.headings > 0))
                self.tags = 0
            self.parts = []
            self.linked = 0

    def _pop(self):
        tag, side, self.region, self.doubt = self.open.pop()
        self.count[tag] -= 1
        if self.blocks and self.blocks[-1] == len(self.open):
            self.blocks.pop()
        self.side -= side
        self.headings -= tag in HEADINGS
        self.articles -= tag in ARTICLE
        self.links -= tag == "a"

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag == "br":
            self.parts.append(" ")
            return
        if tag not in INLINE:
            self._flush()
        if tag in VOID:
            return
        while self.open and tag in CLOSED_BY.get(self.open[-1][0], ()):
            self._pop()
        if tag in CLOSED_BY["p"] and not self.side:
            # an open paragraph ends here, with whatever inline elements it left open
            if self.blocks and self.open[self.blocks[-1]][0] == "p":
                last = self.blocks[-1]
                while len(self.open) > last:
                    self._pop()
        kind = self._is_side(tag, attrs)
        side = kind == 2
        if tag not in INLINE:
            self.blocks.append(len(self.open))
        self.open.append((tag, side, self.region, self.doubt))
        self.count[tag] = self.count.get(tag, 0) + 1
        self.side += side
        self.links += tag == "a"
        self.headings += tag in HEADINGS
        if kind == 1:
            self.doubts.append(self.doubt)
            self.doubt = len(self.doubts) - 1
        if (tag in ARTICLE or tag in REGIONS) and not self.articles:
            self.above.append(self.region)
            self.region = len(self.above) - 1
            if tag in ARTICLE:
                self.marked.add(self.region)
        self.articles += tag in ARTICLE

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open and self.open[-1][0] == tag and tag in ("svg", "iframe", "script"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.tags += 1
        if tag not in INLINE:
            self._flush()
        if self.count.get(tag):
            while True:
                last = self.open[-1][0]
                self._pop()
                if last == tag:
                    break

    def handle_data(self, data):
        if not self.side:
            self.parts.append(data)
            if self.links:
                self.linked += len(data.strip())


def page_lines(html: str) -> tuple[list[Line], list[int], set[int]]:
    """The lines, the region around each region, and the regions that are marked as articles.

    Doubtful elements are left out here, except those that hold more than half of the text.
    """
    parser = _Lines()
    parser.feed(html)
    parser.close()
    parser._flush()
    lines, around = parser.lines, parser.doubts
    if len(around) > 1:
        held = [0] * len(around)
        for line in lines:
            held[line.doubt] += len(line.text)
        total = sum(held)
        for one in range(len(around) - 1, 0, -1):  # an element has a larger number than the one around it
            held[around[one]] += held[one]
        out = [False] * len(around)
        for one in range(1, len(around)):
            out[one] = out[around[one]] or 2 * held[one] <= total
        lines = [x for x in lines if not out[x.doubt]]
    return lines, parser.above, parser.marked


def _common(regions: list[int], above: list[int]) -> int:
    """The smallest region around all of them. A region has a larger number than the one around it."""
    low = set(regions)
    while len(low) > 1:
        last = max(low)
        low.remove(last)
        low.add(above[last])
    return low.pop()


def smooth(values: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian smoothing with mirrored ends."""
    reach = max(1, int(3 * sigma))
    weights = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    padded = np.pad(values, reach, mode="symmetric" if len(values) >= reach else "edge")
    return np.convolve(padded, weights / weights.sum(), "valid")


def main_text(html: str | None, sigma: float = 1.0, share: float = 0.5, dense: float = 100.0) -> str:
    """The article's blocks in page order, joined by one blank.

    A line is content if its smoothed ratio reaches ``share`` of the ratios' standard deviation; ratios from ``dense``
    characters a tag up are alike, so a very long line does not speak against the others. A region points to the article
    if content lines hold at least ``share`` of its characters. All regions below the common ancestor of these are taken
    but those with most of their characters in links; a page of links alone is taken. Where regions marked as articles
    hold text, they alone are taken, and the headings that stand right before them in the region around them.
    """
    lines, above, marked = page_lines(html or "")
    if not lines:
        return ""
    if any(x.region in marked for x in lines):
        taken = [x.region in marked for x in lines]
        for n in range(len(lines) - 2, -1, -1):
            follows = lines[n + 1]
            if lines[n].heading and taken[n + 1] and lines[n].region in (above[follows.region], follows.region):
                taken[n] = True
        return " ".join(x.text for x, ok in zip(lines, taken, strict=True) if ok)
    ratios = smooth(np.array([min(dense, len(x.text) / max(1, x.tags)) for x in lines]), sigma)
    content = ratios >= min(share * ratios.std(), ratios.max())
    full: dict[int, int] = {}
    good: dict[int, int] = {}
    linked: dict[int, int] = {}
    for line, ok in zip(lines, content, strict=True):
        full[line.region] = full.get(line.region, 0) + len(line.text)
        good[line.region] = good.get(line.region, 0) + len(line.text) * bool(ok)
        linked[line.region] = linked.get(line.region, 0) + line.linked
    plain = [r for r in full if 2 * linked[r] <= full[r]]
    chosen = [r for r in plain or full if good[r] >= share * full[r]] or plain
    top = _common(chosen, above)
    inside = [r == top for r in range(len(above))]
    for r in range(top + 1, len(above)):
        inside[r] = inside[above[r]]
    taken = {r for r in plain or full if inside[r]}
    return " ".join(x.text for x in lines if x.region in taken)


def extract_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` with text (the page's main text) and n_chars (its code points).

    The whole page is read, however long or broken; null and empty pages, and pages without any article text, have the
    empty text. Repeated rows give repeated results. Input columns text and n_chars are replaced.
    """
    B.prepare(pages.sparkSession)

    def compute(block):
        texts = [main_text(x) for x in block.column(html).to_pylist()]
        return [texts, [len(t) for t in texts]]

    fields = [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]
    return B.annotate(pages, html, pages.columns, fields, compute)
