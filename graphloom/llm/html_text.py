"""Operator 9, HTML extraction: parser events, text-to-tag ratio, Gaussian smoothing, clustering.

The standard library's parser streams events. They become lines, one per block of the page, each with its
text, its tags and the share of its text inside links. The ratio of text to tags per line, smoothed
with a Gaussian, is split in two clusters by a threshold found by two-means; lines of the upper cluster mark content regions.
A region is the container (article, main or the innermost block that holds it) around them, without the
containers that markup or class names tell to be boilerplate.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import few_tasks, releasing, slices, table

_BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html "
    "legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
_RAW = frozenset("script style noscript template svg math iframe object canvas textarea select button title head".split())
#: What may stand in a head; anything else ends it. What holds a body start tag as text.
_IN_HEAD = frozenset("base basefont bgsound link meta title style script noscript template head".split())
_HOLDS_BODY = frozenset("iframe template textarea".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BOILER_TAGS = frozenset("nav header footer aside form menu dialog".split())
_BOILER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
_BOILER_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disclaimer discussion footer "
    "gdpr header login masthead menu nav navbar navigation newsletter notice pagination popup promo promoted related replies reply respond search share sharing "
    "sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget".split()
)
_TOKENS = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")
_WHITE = re.compile(r"\s+")


@dataclass
class Node:
    tag: str
    parent: Node | None
    boiler: bool
    article: Node | None  #: the outermost article or main element that holds it


@dataclass
class Line:
    node: Node
    parts: list[str] = field(default_factory=list)
    tags: int = 1
    linked: int = 0
    text: str = ""


def _boilerplate(tag: str, attrs: dict[str, str | None], in_article: bool) -> bool:
    if tag == "header" and in_article:
        return False  # an article's own head
    if tag in _BOILER_TAGS or (attrs.get("role") or "").lower() in _BOILER_ROLES:
        return True
    if "hidden" in attrs or (attrs.get("aria-hidden") or "").lower() == "true":
        return True
    if tag in ("html", "body", "article", "main"):
        return False
    names = f"{attrs.get('class') or ''} {attrs.get('id') or ''}"
    return any(w.lower() in _BOILER_WORDS for w in _TOKENS.findall(names))


class LineParser(HTMLParser):
    """Turns events into lines. Blocks nest on a stack; an end tag closes up to its own start."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("", None, False, None)
        self.stack = [self.root]
        self.raw: list[str] = []
        self.inner: list[str] = []  # blocks that are open inside raw elements
        self.links = 0
        self.lines = [Line(self.root)]

    def _break(self) -> None:
        if self.lines[-1].parts:
            self.lines.append(Line(self.stack[-1]))
        else:
            self.lines[-1].node = self.stack[-1]

    def handle_starttag(self, tag, attrs):
        if self.raw and (self.raw[-1] not in _HOLDS_BODY if tag == "body" else self.raw[-1] == "head" and tag not in _IN_HEAD):
            self._leave_raw()
        if self.raw:
            if tag == self.raw[-1] or self.raw[-1] == "head" and tag in _RAW:
                self.raw.append(tag)
            elif tag in _BLOCKS and tag not in _VOID:
                self.inner.append(tag)
            return
        if tag in _RAW:
            self.raw.append(tag)
            return
        self.lines[-1].tags += 1
        if tag == "br":
            self.lines[-1].parts.append(" ")
        if tag == "a":
            self.links += 1
        if tag not in _BLOCKS:
            return
        if tag != "hr":
            if tag in ("p", "li", "dt", "dd", "tr", "td", "th", "option"):
                self._close_implied(tag)
            elif self.stack[-1].tag == "p":
                self.stack.pop()
            above = self.stack[-1]
            known = dict(attrs)
            node = Node(tag, above, above.boiler or _boilerplate(tag, known, above.article is not None), above.article)
            if node.article is None and (tag in ("article", "main") or (known.get("role") or "") == "main"):
                node.article = node
            self.stack.append(node)
        self._break()

    def _leave_raw(self) -> None:
        self.raw.clear()
        self.inner.clear()

    def _ends_raw(self, tag: str) -> bool:
        """Close what an end tag closes among raw elements; whether it is that of a block around all of them."""
        for opened in (self.inner, self.raw):
            if tag in opened:
                del opened[len(opened) - 1 - opened[::-1].index(tag) :]
                if not self.raw:
                    self.inner.clear()
                return False
        if tag == "head" or tag in _BLOCKS and any(x.tag == tag for x in self.stack):
            self._leave_raw()
        return not self.raw and tag != "head"

    def _close_implied(self, tag: str) -> None:
        closes = {"p": ("p",), "li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr", "td", "th", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p"), "option": ("option",)}[tag]
        while self.stack[-1].tag in closes:
            last = self.stack.pop().tag
            if last == closes[0] and tag not in ("tr", "td", "th", "dd", "dt"):
                break

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID and tag in ("svg", "math", "script", "iframe", "object", "canvas"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if self.raw and not self._ends_raw(tag):
            return
        self.lines[-1].tags += 1
        if tag == "a":
            self.links = max(0, self.links - 1)
        if tag not in _BLOCKS or tag in _VOID:
            return
        for depth in range(len(self.stack) - 1, 0, -1):
            if self.stack[depth].tag == tag:
                del self.stack[depth:]
                break
        self.links = 0
        self._break()

    def handle_data(self, data):
        if self.raw == ["head"] and data.strip():
            self._leave_raw()
        if self.raw:
            return
        line = self.lines[-1]
        line.parts.append(data)
        if self.links:
            line.linked += len(data)


def gaussian(values: list[float], sigma: float) -> list[float]:
    """Smoothed values; the kernel is renormalised at the ends."""
    reach = math.ceil(3 * sigma)
    kernel = [math.exp(-(d * d) / (2 * sigma * sigma)) for d in range(-reach, reach + 1)]
    out = []
    for i in range(len(values)):
        lo, hi = max(0, i - reach), min(len(values), i + reach + 1)
        k = kernel[lo - i + reach : hi - i + reach]
        out.append(sum(a * b for a, b in zip(values[lo:hi], k, strict=True)) / sum(k))
    return out


def threshold(values: list[float]) -> float:
    """Where two-means over the values puts the border; all equal: below them."""
    low, high = min(values), max(values)
    if high - low < 1e-9:
        return low - 1
    while True:
        cut = (low + high) / 2
        a, b = [v for v in values if v <= cut], [v for v in values if v > cut]
        new = sum(a) / len(a), sum(b) / len(b)
        if abs(new[0] - low) + abs(new[1] - high) < 1e-9:
            return cut
        low, high = new


def main_text(html: str, sigma: float = 1.0) -> str:
    """The page's main text, blocks joined by a newline.

    Lines of content are those of the upper cluster. One that stands inside an article or main element brings
    all lines of the outermost such element, however short; another one brings the lines of its block, and
    headings right before it. Boilerplate containers never count.
    """
    parser = LineParser()
    parser.feed(html)
    parser.close()
    lines = []
    for line in parser.lines:
        line.text = _WHITE.sub(" ", "".join(line.parts)).strip()
        if line.text:
            lines.append(line)
    usable = [x for x in lines if not x.node.boiler]
    if not usable:
        return ""
    ratio = [math.log1p(max(0, len(x.text) - x.linked) / x.tags) if not x.node.boiler else 0.0 for x in lines]
    smooth = dict(zip(map(id, lines), gaussian(ratio, sigma), strict=True))
    cut = threshold(list(smooth.values()))
    upper = [x for x in usable if smooth[id(x)] > cut and x.linked * 2 <= len(x.text)] or [max(usable, key=lambda x: len(x.text) - x.linked)]
    regions = {id(x.node.article or x.node.parent or x.node) for x in upper}
    chosen = [x for x in usable if id(x.node.article or x.node.parent or x.node) in regions and (x.node.article or x.linked * 2 <= len(x.text))]
    return "\n".join(x.text for x in chosen)


_OUT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", sigma: float = 1.0) -> DataFrame:
    """page_id, url, text, n_chars of every row, without a shuffle.

    Null and empty html and pages without content give the empty text. Repeated rows and null ids give a row
    each; an empty table gives an empty result; other columns are ignored.
    """

    @releasing
    def run(batches):
        for b in slices(batches):
            text = [main_text(h or "", sigma) for h in b.column(2).to_pylist()]
            yield pa.record_batch([b.column(0), b.column(1), text, [len(t) for t in text]], schema=_OUT)

    return few_tasks(pages).select(F.col(id_col).cast("long"), F.col(url_col).cast("string"), html_col).mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))
