"""Main text of web pages by line-block distribution.

Markup is stripped first: scripts, styles, forms and comments go, and so do elements that are marked as
menus, headers, footers, sidebars, notices, adverts or reader comments, by tag, role, class or id. What
is left is a list of lines, one for each block element. A line weighs as much as it has text outside
links, if that is half of it at least; lines of a marked article weigh at least a third of ``SURGE`` and count
their links. Over every ``WINDOW`` lines the weights are summed. The distribution surges where a line of weight has
a window that comes to ``SURGE``; from there the text reaches back and forth to the dives, the lines without weight
whose window falls below ``SURGE``. All lines between are text. Lines of an article and lines outside have
distributions of their own, so a loose line beside an article does not join it. The stretch that weighs most is the
result, wherever it stands, with every other one of a marked article. A page whose distribution never surges is
one stretch.

Tags are found in one walk over the page. A quote shields ``>`` only as an attribute's value, and no longer
once a tag has turned out to be left open, so broken markup costs no more than sound markup.

A null or empty html, or one without text, gives the empty text. Repeated rows, extra columns and empty
tables need nothing special. Whole pages are read, however long; a page is judged by itself.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

WINDOW, SURGE = 3, 80
_STOP, _NAME = re.compile("[>\"']"), re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_MARKS = {"class", "id", "role", "style", "hidden", "aria-hidden"}
#: Class names that tell of a layout, such as "has-sidebar", mark no element.
_LAYOUT = re.compile(r"\b(?:has|with|no|without)[-_]+[a-z]+")
#: Content that is never text.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "select", "object", "canvas", "math", "xmp"}
DROPPED = {"head", "nav", "footer", "aside", "form", "button", "menu", "dialog", "header"}
CONTAINERS = DROPPED | {"html", "body", "div", "section", "article", "main", "ul", "ol", "dl", "table", "figure", "details", "blockquote", "fieldset", "span"}
BLOCKS = CONTAINERS - {"span"} | {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "tr", "pre", "hr", "address", "figcaption", "summary", "caption", "center", "legend"}
#: Words in a class or id that mark what is not the article.
NOT_TEXT = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay "
    "newsletter subscribe subscription sidebar side rail aside nav navbar navigation menu breadcrumb breadcrumbs header masthead topbar footer foot comment comments "
    "disqus reply replies respond discussion related recommended share sharing social widget pagination pager login signup skip toolbar copyright disclaimer".split()
)
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar"}
#: Such words on an article tell of readers' comments, or of another article.
READERS = {"comment", "comments", "reply", "replies", "respond"} | {"teaser", "teasers", "related", "recommended", "promo", "promotion", "sponsored", "advert", "advertisement"}
#: Words that on a heading, paragraph, item or row only tell where it stands.
PLACES = {"header", "masthead", "topbar", "side", "rail", "foot"}
#: Blocks that end where another of their group begins, and may hold blocks themselves.
ITEMS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}} | {t: {t} for t in ("pre", "address", "figcaption", "summary", "caption", "center", "legend")}
#: Blocks that end where any block begins.
LINES = {"p", "h1", "h2", "h3", "h4", "h5", "h6"}


def _unwanted(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in ("html", "body", "main"):
        return False
    if tag in DROPPED and not (tag == "header" and in_article):
        return True
    if not attributes:
        return False
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name not in _MARKS:
            continue
        if name in ("class", "id"):
            found = set(re.split(r"[^a-z]+", _LAYOUT.sub(" ", value)))
            if found & (READERS if tag == "article" else NOT_TEXT - PLACES if tag in LINES or tag in ITEMS else NOT_TEXT - {"header"} if in_article else NOT_TEXT):
                return True
        elif name == "role" and value in ROLES or name == "hidden" and tag != "article" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
    return False


class Tags:
    """The tags of a page in one walk: (start, end, closes, name, attributes); comments have no name."""

    def __init__(self, html: str):
        self.html, self.last, self.quotes = html, html.rfind(">"), True

    def after(self, at: int) -> tuple[int, int, bool, str, str] | None:
        """The next tag from ``at`` on."""
        html = self.html
        while 0 <= (at := html.find("<", at)) < self.last:
            if html.startswith("<!--", at):
                end = html.find("-->", at + 4)
                return at, len(html) if end < 0 else end + 3, False, "", ""
            if html.startswith(("<!", "<?"), at):
                return at, html.find(">", at) + 1, False, "", ""
            closes = html.startswith("/", at + 1)
            if name := _NAME.match(html, at + 1 + closes):
                end = self._end(name.end())
                return at, end, closes, name[0].lower(), html[name.end() : end - 1]
            at += 1
        return None

    def _end(self, at: int) -> int:
        """Where the tag that is open at ``at`` ends."""
        html, here = self.html, at
        while self.quotes:
            m = _STOP.search(html, here)
            if m and m[0] == ">":
                return m.end()
            if not m:
                self.quotes = False
            elif not html[max(at, m.start() - 64) : m.start()].rstrip().endswith("="):
                here = m.end()
            elif (close := html.find(m[0], m.end())) < 0:
                self.quotes = False
            else:
                here = close + 1
        return html.find(">", at) + 1


def lines(html: str) -> list[tuple[str, int, bool]]:
    """Text, length outside links, and whether it stands in a marked article, for every block."""
    out: list[tuple[str, int, bool]] = []
    parts: list[str] = []
    stack: list[tuple[str, bool]] = []  # open containers, and items that are dropped; and whether each is dropped
    opened: Counter[str] = Counter()
    dropped = articles = links = loose = 0
    muted = False  # in a dropped heading or paragraph
    tags, at = Tags(html), 0

    def take(raw: str) -> None:
        nonlocal loose
        text = unescape(raw)
        parts.append(text)
        if not links:
            loose += len("".join(text.split()))

    def flush() -> None:
        nonlocal loose
        if parts:
            if text := " ".join("".join(parts).split()):
                out.append((text, loose, articles > 0))
            parts.clear()
        loose = 0

    def close(tag: str) -> None:
        """Close everything down to the last open ``tag``."""
        nonlocal dropped, articles
        while stack:
            t, bad = stack.pop()
            opened[t] -= 1
            dropped -= bad
            articles -= t in ("article", "main")
            if t == tag:
                break

    while True:
        found = tags.after(at)
        if not dropped and not muted and (end := found[0] if found else len(html)) > at:
            take(html[at:end])
        if not found:
            break
        _, at, closes, tag, attributes = found
        if not tag:
            continue
        alone = attributes.endswith("/")
        if tag in RAW and not closes:
            if not alone:
                over = re.compile(rf"</{re.escape(tag)}(?![\w-])", re.I).search(html, at)
                at = html.find(">", over.end()) + 1 or len(html) if over else len(html)
            continue
        if tag == "br" or tag in ("td", "th"):
            parts.append(" ")
        if tag == "a":
            links = 0 if closes else 1
        if tag in BLOCKS:
            flush()
            links = links if tag in ("p", "li", "div", "span", "h1", "h2", "h3", "h4", "h5", "h6") and not closes else 0
            muted = False
        if alone:
            continue
        if tag in ITEMS:
            if not closes:
                if stack and stack[-1][0] in ITEMS[tag]:  # only dropped items are on the stack
                    close(stack[-1][0])
                if attributes and not dropped and _unwanted(tag, attributes, articles > 0):
                    flush()
                    stack.append((tag, True))
                    opened[tag] += 1
                    dropped += 1
            elif opened[tag] and stack[-1][0] == tag:
                close(tag)
            continue
        if tag in LINES:
            muted = bool(not closes and attributes and not dropped and _unwanted(tag, attributes, articles > 0))
            continue
        if tag not in CONTAINERS:
            continue
        if not closes:
            bad = _unwanted(tag, attributes, articles > 0)
            if bad and not dropped:
                flush()
            stack.append((tag, bad))
            opened[tag] += 1
            dropped += bad
            articles += tag in ("article", "main")
        elif opened[tag]:
            close(tag)
    flush()
    return out


def weights(found: list[tuple[str, int, bool]]) -> list[int]:
    """What each line weighs: all of its text in a marked article, else its text outside links."""
    solid = [len(text.replace(" ", "")) for text, _, _ in found]
    apart = [loose if 2 * loose >= n and not text.startswith("\N{COPYRIGHT SIGN}") else 0 for n, (text, loose, _) in zip(solid, found, strict=True)]
    return [max(SURGE // WINDOW + 1, n) if inside else w for n, w, (_, _, inside) in zip(solid, apart, found, strict=True)]


def sums(weight: list[int]) -> list[int]:
    """The weight of the ``WINDOW`` lines from each on."""
    return [sum(weight[i : i + WINDOW]) for i in range(len(weight))]


def stretches(weight: list[int]) -> list[tuple[int, int]]:
    """Runs of lines with weight, or whose window comes to ``SURGE``, if one line of a run has both."""
    held, out, i = sums(weight), [], 0
    while i < len(weight):
        j, surges = i, False
        while j < len(weight) and (weight[j] or held[j] >= SURGE):
            surges |= bool(weight[j] and held[j] >= SURGE)
            j += 1
        if surges:
            a, b = i, j
            while not weight[a]:
                a += 1
            while not weight[b - 1]:
                b -= 1
            out.append((a, b))
        i = max(j, i + 1)
    heavy = [k for k, w in enumerate(weight) if w]
    return out or ([(heavy[0], heavy[-1] + 1)] if heavy else [])


def extract(html: str | None) -> str:
    """The main text: blocks between surge and dive, joined by empty lines."""
    found = lines(html or "")
    weight = weights(found)
    edges = [0, *(i for i in range(1, len(found)) if found[i][2] != found[i - 1][2]), len(found)]
    spans = [(a + i, a + j) for a, b in zip(edges, edges[1:], strict=False) for i, j in stretches(weight[a:b])]
    best = max(spans, key=lambda s: (sum(weight[slice(*s)]), -s[0]), default=None)
    kept = [s for s in spans if s == best or any(inside for _, _, inside in found[slice(*s)])]
    return "\n\n".join(text for s in kept for text, _, _ in found[slice(*s)])


def main_text(pages: DataFrame, html_col: str = "html", carry: list[str] | None = None) -> DataFrame:
    """``carry`` columns and ``text`` for every row."""
    carry = carry or ["page_id", "url"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array([extract(h.as_py()) for h in b.column(0)], pa.string())], [*carry, "text"])

    small_batches(pages.sparkSession)
    kinds = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in carry)
    return pages.select(F.col(html_col).alias("_html"), *carry).mapInArrow(run, f"{kinds}, text string")
