"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one per block of text.  What is never part of
an article (menus, headers, footers, sidebars, notices, adverts, forms,
scripts, comments of readers) is known by its element, role or class and
leaves blank lines, more between parts of the page than amid one, as do the
borders of containers.  The lengths of
``WINDOW`` lines from each line on are added up.  Text surges where such a sum
reaches the threshold and dives where a sum is zero; all text between a surge
and its dive is kept, short lines included.  The threshold is ``SURGE`` or half
of the page's largest sum, whichever is less, so that a short article
surges too.  Where a page marks its article (``article``, or else ``main``),
lines outside of the longest one count as blank, and what is left out inside
of it leaves no gap.

Edge cases: null and empty pages, and pages without text, give an empty text;
unclosed elements end with their parent; a repeated row gives a repeated
result; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.batches import slices

WINDOW = 3
SURGE = 86

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>",  # an attribute's quote is not closed
    re.S,
)
RAW_END = {
    name: re.compile(rf"</{name}\s*>", re.I) for name in ("script", "style", "textarea", "title")
}
MARKS = re.compile(r"(class|id|role|style|hidden|aria-hidden)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)

# Names of elements and classes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby "
    "s samp small span strike strong sub sup time tt u var wbr img br td th".split()
)
CONTAINERS = frozenset("div section article main ul ol dl table body aside fieldset".split())
LEFT_OUT = frozenset(
    "script style noscript template iframe object svg canvas head title form button select option "
    "textarea nav footer aside menu dialog audio video map".split()
)
LEFT_OUT_ROLES = frozenset(
    "navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar "
    "toolbar".split()
)
LEFT_OUT_CLASSES = frozenset(
    "ad ads advert adverts advertisement advertising sponsored sponsor promo promotion banner nav "
    "navbar navigation menu submenu breadcrumb breadcrumbs sidebar footer cookie cookies consent "
    "notice notices gdpr popup modal overlay newsletter subscribe subscription signup signin login "
    "social share sharing related recommended comment comments commentlist disqus reply replies "
    "respond discussion widget widgets pagination pager toolbar skip".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


def _left_out(name: str, attributes: str, in_article: bool) -> bool:
    if name in LEFT_OUT:
        return True
    if name == "header":
        return not in_article
    if name in ("html", "body", "article", "main") and not in_article:
        return False
    if not attributes:
        return False
    for match in MARKS.finditer(attributes):
        mark, value = match[1].lower(), (match[2] or "").strip("\"'").lower()
        if mark in ("class", "id"):
            words = re.split(r"[^a-z0-9]+", value)
            if not LEFT_OUT_CLASSES.isdisjoint(words) or "header" in words and not in_article:
                return True
        elif mark == "role" and value in LEFT_OUT_ROLES:
            return True
        elif mark == "hidden" and match[2] is None or mark == "aria-hidden" and value == "true":
            return True
        elif mark == "style" and "display:none" in value.replace(" ", ""):
            return True
    return False


class _Page:
    """Lines of a page, with the number of the article that each lies in."""

    def __init__(self) -> None:
        self.lines: list[tuple[str, int, int]] = []  # text, article, main
        self.pieces: list[str] = []
        self.open: list[tuple[str, bool]] = []  # name, whether it is left out
        self.skipping = 0
        self.article = self.main = 0  # number of the one that is open, else 0
        self.articles = self.mains = 0
        self.linked = self.length = 0  # characters of the line, and of its links

    def end_line(self) -> None:
        if self.pieces:
            text = " ".join("".join(self.pieces).split())
            self.pieces = []
            inside = self.article or self.main
            if text and (inside or self.linked * 2 <= self.length):
                self.lines.append((text, self.article, self.main))
            elif text:
                self.blank()  # mostly links: a menu
        self.linked = self.length = 0

    def blank(self, lines: int = 1) -> None:
        if not (self.article or self.main):
            self.lines.extend([("", 0, 0)] * lines)

    def text(self, raw: str) -> None:
        if not self.skipping and raw:
            self.pieces.append(html.unescape(raw) if "&" in raw else raw)
            shown = len(raw.strip())
            self.length += shown
            if any(name == "a" for name, _ in self.open):
                self.linked += shown

    def start(self, name: str, attributes: str) -> None:
        inside = bool(self.article or self.main)
        out = _left_out(name, attributes, inside)
        if name not in INLINE or out:
            self.end_line()
        elif name in ("br", "td", "th") and not self.skipping:
            self.pieces.append(" ")
        if name in VOID:
            return
        if out:
            if not self.skipping:
                # Amid a text an advert is no end of it; between parts of the page it is.
                parent = next((o for o, _ in reversed(self.open) if o in CONTAINERS), "body")
                self.blank(WINDOW if parent == "body" else 1)
            self.skipping += 1
        elif name in CONTAINERS and not self.skipping:
            self.blank()
            if name == "article" and not self.article:
                self.articles += 1
                self.article = self.articles
            elif name == "main" and not self.main:
                self.mains += 1
                self.main = self.mains
        self.open.append((name, out))

    def end(self, name: str) -> None:
        if name not in INLINE:
            self.end_line()
        if not any(opened == name for opened, _ in self.open):
            return
        while self.open:
            opened, out = self.open.pop()
            self.skipping -= out
            if opened == "article" and not any(o == "article" for o, _ in self.open):
                self.article = 0
            elif opened == "main" and not any(o == "main" for o, _ in self.open):
                self.main = 0
            if opened == name:
                break
        if name in CONTAINERS and not self.skipping:
            self.blank()


def page_lines(page: str) -> list[str]:
    """The page's lines of text; blank where something else stood."""
    state, at, end = _Page(), 0, len(page)
    while at < end:
        match = TOKEN.search(page, at)
        if match is None:
            state.text(page[at:])
            break
        state.text(page[at : match.start()])
        at = match.end()
        slash, name, attributes = (match[1], match[2], match[3]) if match[2] else match.group(4, 5, 6)
        if not name:
            continue
        name = name.lower()
        if slash:
            state.end(name)
            continue
        state.start(name, attributes)
        if attributes.endswith("/") and name not in VOID and name not in CONTAINERS and name not in INLINE:
            state.end(name)
        elif name in RAW_END:
            closing = RAW_END[name].search(page, at)
            at = closing.end() if closing else end
            state.end(name)
    state.end_line()
    for place in (1, 2):
        lengths: dict[int, int] = {}
        for line in state.lines:
            if line[place]:
                lengths[line[place]] = lengths.get(line[place], 0) + len(line[0])
        if lengths:
            longest = max(lengths, key=lengths.get)
            return [line[0] if line[place] == longest else "" for line in state.lines]
    return [line[0] for line in state.lines]


def dense_lines(lines: list[str]) -> list[str]:
    """The lines between each surge and its dive."""
    lengths = [len(line) for line in lines]
    sums = [sum(lengths[i : i + WINDOW]) for i in range(len(lengths))]
    surge = min(SURGE, max(sums, default=0) / 2)
    kept, i = [], 0
    while i < len(sums):
        if not sums[i]:
            i += 1
            continue
        dive = next((j for j in range(i, len(sums)) if not sums[j]), len(sums))
        if max(sums[i:dive]) >= surge:
            kept.extend(line for line in lines[i:dive] if line)
        i = dive
    return kept


def main_text(page: str | None) -> str:
    return "\n".join(dense_lines(page_lines(page))) if page else ""


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars): the main text of every page."""

    def mapped(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                texts = [main_text(p) for p in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("page_id"),
                        part.column("url"),
                        pa.array(texts, pa.string()),
                        pa.array([len(t) for t in texts], pa.int64()),
                    ],
                    ["page_id", "url", "text", "n_chars"],
                )

    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.col("html").cast("string").alias("html"),
    )
    return rows.mapInArrow(mapped, "page_id long, url string, text string, n_chars long")
