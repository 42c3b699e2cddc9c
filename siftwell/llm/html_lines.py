"""Main text of web pages by line-block distribution."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements that end a line, elements without an end tag, elements and names that are not the article.
LINES = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
OUTSIDE = frozenset(
    "script style noscript template head title nav footer aside button select option textarea iframe object svg canvas audio video map "
    "dialog menu".split()
)
FORMS = frozenset("form fieldset".split())
OUTSIDE_ROLES = frozenset(
    "navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar".split()
)
OUTSIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner sidebar nav navbar navigation menu "
    "breadcrumb breadcrumbs footer masthead cookie cookies consent gdpr notice notices alert popup modal newsletter subscribe "
    "paywall comment comments disqus replies respond share sharing social related recommended trending pagination pager toolbar".split()
)
OUTSIDE_NAMES = frozenset("header site-header page-header top-bar topbar".split())
# A name with such a beginning says how something else is laid out; words that name a part a layout may be called after.
LAYOUT = ("has-", "with-", "without-", "no-", "is-", "has_", "with_", "no_", "is_")
LAYOUT_WORDS = frozenset("sidebar nav navbar navigation menu banner footer masthead toolbar breadcrumb breadcrumbs".split())


@dataclass(frozen=True)
class Window:
    """Lines whose lengths are summed, and the sum at which a text surges where the page does not mark its article."""

    lines: int = 3
    surge: int = 80


# Elements whose content is not markup, up to their own end tag.
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
_TAG = re.compile(r"</?[a-zA-Z][^\s/<>]*")
_QUOTE = re.compile(r"[\"'>]")
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:@][^\s=/>"']*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+))?""")


def _tag_end(html: str, at: int) -> int:
    """Place of the > that ends the tag whose name ends at ``at``, quoted values skipped; -1 if the page breaks off inside it."""
    first = html.find(">", at)
    while True:
        found = _QUOTE.search(html, at)
        if found is None:
            return first
        if found[0] == ">":
            return found.start()
        close = html.find(found[0], found.end())
        if close < 0:  # a stray quote
            return first
        at = close + 1


class _Lines:
    """A page as lines: (text, characters outside links, inside the marked article, inside a form, container); removed parts leave a gap.

    The container is the number of the element that holds the line's own block.
    What is called after a layout is cut only as far as it does not hold the
    first marked article, and ``main`` is never cut by its name. The page is
    scanned once from left to right, so its cost is its length however broken the
    markup is.
    """

    def __init__(self, gap: int):
        self.gap = gap
        self.out: list[tuple[str, int, bool, bool, int]] = []
        self.parts: list[str] = []
        self.plain = 0
        self.open: list[tuple[str, str]] = []  # open elements and what they are: cut, article, link or nothing
        self.count: dict[str, int] = {}
        self.cut = self.article = self.link = self.form = 0
        self.held: list[int] = []  # numbers of cuts that a marked article inside them has lifted
        self.blocks = [0, 0]  # numbers of the open block elements
        self.number = 0
        self.seen = False  # an article was marked

    def _end_line(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.out.append((text, self.plain, self.article > 0, self.form > 0 and not self.article, self.blocks[-2]))
            self.parts, self.plain = [], 0

    def _gap(self) -> None:
        self._end_line()
        self.out += [("", 0, self.article > 0, False, 0)] * self.gap

    def _kind(self, tag: str, attributes: str) -> str:
        if tag in ("body", "html"):
            return ""
        values = {}
        for m in _ATTRIBUTE.finditer(attributes):
            values.setdefault(m[1].lower(), (m[2] or "").strip("\"'"))
        names = f"{values.get('class', '')} {values.get('id', '')}".lower()
        role = values.get("role", "").lower()
        hidden = "hidden" in values or values.get("aria-hidden") == "true" or "display:none" in values.get("style", "").replace(" ", "").lower()
        if tag in OUTSIDE or role in OUTSIDE_ROLES or hidden or (tag == "header" and not self.article):
            return "cut"
        whole = [n for n in names.split() if not n.startswith(LAYOUT)]
        words = OUTSIDE_WORDS & set(re.split(r"[^a-z0-9]+", " ".join(whole)))
        main = tag == "main" or role == "main"
        if words and not (main or words <= LAYOUT_WORDS) or OUTSIDE_NAMES & set(whole):
            return "cut"
        if main or tag == "article" or role == "article" or values.get("itemprop") == "articleBody":
            return "article"
        if words:
            return "layout"
        if tag in FORMS:
            return "cut" if self.article else "form"
        return "link" if tag == "a" else ""

    def _leave(self) -> str:
        tag, kind = self.open.pop()
        self.count[tag] -= 1
        if tag in LINES:
            self.blocks.pop()
        if kind in ("cut", "layout"):
            self.cut -= 1
        elif kind in ("article", "lifted"):
            self._gap()
            self.article -= 1
            if kind == "lifted":
                self.cut = self.held.pop()
        elif kind == "link":
            self.link -= 1
        elif kind == "form":
            self._end_line()
            self.form -= 1
        return tag

    def _start(self, tag: str, attributes: str) -> None:
        if tag == "body":
            while self.count.get("head"):
                self._leave()
        if tag in LINES and not self.cut:
            self._end_line()
        if tag == "br" and not self.cut:
            self.parts.append(" ")
        if tag in VOID:
            return
        kind = self._kind(tag, attributes)
        if kind in ("cut", "layout"):
            if not self.cut and tag in LINES:
                self._gap()
            self.cut += 1
        elif kind == "article":
            if self.cut and not self.seen and all(k != "cut" for _, k in self.open):
                kind = "lifted"
                self.held.append(self.cut)
                self.cut = 0
            self._gap()
            self.article += 1
            self.seen = self.seen or not self.cut
        elif kind == "link":
            self.link += 1
        elif kind == "form":
            self._end_line()
            self.form += 1
        if tag in LINES:
            self.number += 1
            self.blocks.append(self.number)
        self.open.append((tag, kind))
        self.count[tag] = self.count.get(tag, 0) + 1

    def _end(self, tag: str) -> None:
        if tag in LINES and not self.cut:
            self._end_line()
        if self.count.get(tag):
            while self._leave() != tag:
                pass

    def _text(self, data: str) -> None:
        if data and not self.cut:
            data = unescape(data)
            self.parts.append(data)
            if not self.link:
                self.plain += len(data)

    def read(self, html: str) -> list[tuple[str, int, bool]]:
        at, n = 0, len(html)
        while at < n:
            mark = html.find("<", at)
            if mark < 0:
                self._text(html[at:])
                break
            self._text(html[at:mark])
            if html.startswith("<!--", mark):
                end = html.find("-->", mark + 4)
                at = n if end < 0 else end + 3
                continue
            name = _TAG.match(html, mark)
            if name is None:
                other = html[mark + 1 : mark + 2] in ("!", "?", "/")
                end = html.find(">", mark) if other else mark
                if not other:
                    self._text("<")
                at = n if end < 0 else end + 1
                continue
            end = _tag_end(html, name.end())
            if end < 0:  # the page broke off inside a tag
                break
            tag, at = name[0].strip("</").lower(), end + 1
            if name[0][1] == "/":
                self._end(tag)
                continue
            attributes = html[name.end() : end]
            self._start(tag, attributes)
            if tag in RAW:
                close = re.compile(f"</{tag}", re.I).search(html, at)
                if close is None:
                    break
                if tag not in OUTSIDE:
                    self._text(html[at : close.start()])
                at = close.start()
            elif attributes.endswith("/") and tag not in VOID:
                self._end(tag)
        self._end_line()
        return self.out


def extract(html: str | None, window: Window = Window()) -> str:
    """Main text of one page: the lines between each surge of the line-block distribution and the dive after it.

    A line weighs its characters outside links. Where the page marks an article
    (``article``, ``main`` or their roles), lines outside it weigh nothing, every
    line within it weighs something and every surge counts; elsewhere a surge must
    reach ``window.surge``, what stands in a form counts only if nothing else
    surges, and lines in a container of kept lines stay too: all that have text
    outside links, and those of links alone that stand between kept ones or next
    to one. If nothing surges, the heaviest run of lines is the text.
    """
    lines = _Lines(window.lines).read(html or "")
    if not lines:
        return ""
    marked = np.array([x[2] for x in lines])
    full = np.array([bool(x[0]) for x in lines])
    weight = np.array([x[1] for x in lines], np.int64)
    form = np.array([x[3] for x in lines])
    if (marked & (weight > 0)).any():
        full &= marked
        keep = _between(np.where(full, np.maximum(weight, 1), 0), window, 1) & full
    else:
        plain = np.where(form, 0, weight)
        if _blocks(plain, window).max() >= window.surge:
            full, weight = full & ~form, plain
        keep = _between(weight, window, window.surge) & full & (weight > 0)
        container = np.array([x[4] for x in lines])
        beside = full & np.isin(container, np.unique(container[keep]))
        keep |= beside & (weight > 0)
        near = keep.copy()
        near[1:] |= keep[:-1]
        near[:-1] |= keep[1:]
        at = np.flatnonzero(keep)
        if len(at):
            near[at[0] : at[-1]] = True
        keep |= beside & near
    return "\n".join(lines[i][0] for i in np.flatnonzero(keep))


def _blocks(weight: np.ndarray, window: Window) -> np.ndarray:
    """Weight of each line and those behind it, ``window.lines`` in all."""
    total = np.cumsum(np.concatenate((weight, np.zeros(window.lines, np.int64))))
    return total[window.lines - 1 : len(weight) + window.lines - 1] - total[: len(weight)] + weight


def _between(weight: np.ndarray, window: Window, least: int) -> np.ndarray:
    """Lines of the runs between dives, where the block sum falls to zero, in which it reaches ``least``."""
    block = _blocks(weight, window)
    runs = np.cumsum(block == 0)
    risen = np.unique(runs[(block >= least)])
    if not len(risen) and weight.any():
        risen = np.array([np.argmax(np.bincount(runs, weight))])
    return np.isin(runs, risen) & (block > 0)


def main_text(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", window: Window = Window()) -> DataFrame:
    """Per row of ``pages``: key, url, text and n_chars (code points of the text).

    Null or empty html, and pages without text, give an empty text. Character
    references are decoded, white space inside a block becomes one space, blocks
    are joined in page order by a line feed. A page is read whole in one pass,
    however long; repeated rows are each returned; other columns are not read.
    """
    kinds = dict(pages.select(key, url).dtypes)

    def read(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for a in range(0, frame.num_rows, 256):
                part = frame.slice(a, 256)
                texts = [extract(x, window) for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
                    ["k", "u", "text", "n_chars"],
                )

    rows = pages.select(F.col(key).alias("k"), F.col(url).alias("u"), F.col(html).alias("h"))
    out = rows.mapInArrow(read, f"k {kinds[key]}, u {kinds[url]}, text string, n_chars long")
    return out.withColumnsRenamed({"k": key, "u": url})
