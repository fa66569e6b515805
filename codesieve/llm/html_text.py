"""HTML extraction by line-block distribution.

Markup is stripped so that every block element becomes a line. A line's length is that of its text outside
links, and none if most of it is linked; known furniture (menus, forms, adverts, comments ...) makes no lines.
Lengths are summed over a sliding window of lines. The main text begins where the sums surge, goes on until
they dive to nothing, and all lines between are kept. Inside one ``article`` nothing dives: lists of links there
end no text.

``article`` and ``main`` only set how much a surge takes, half as much for each of them that is around a line,
and what belongs to the text at its edges: before the surge the headings and paragraphs that lead up to it
without a dive; not short lines of bare boxes or of copyright, nor lines outside the article that would not surge alone.

Edge cases: a null, empty or markup-free page is treated like any other text (null: empty string, 0
characters); a page on which nothing surges has its densest place for a text; repeated rows give repeated
results; an empty table gives an empty result; other columns of the input are not read. A page of any length
is worked on whole; pages are independent of each other.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lines in a window, the summed length that is a surge where the page marks its text best, and that of a short line.
WINDOW, SURGE, SHORT = 3, 86, 40

# HTML's elements by kind, and the names that pages give to their furniture.
RAW = "script style noscript template title textarea select option svg math iframe object canvas video audio button"
FURNITURE = "nav header footer aside form menu dialog"
ARTICLE = "article main"
BLOCK = (
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul"
)
NAMES = (
    "ad ads adbox adslot advert adverts advertisement advertising alert banner breadcrumb breadcrumbs byline comment comments commentary "
    "consent cookie cookies copyright discussion disqus dropdown footer form gdpr login masthead menu modal nav navbar navigation newsletter notice "
    "notices notification overlay pagination pager popup popover promo promoted promotion recommended related replies reply respond search "
    "share sharing sidebar signup social sponsor sponsored subscribe subscription tags toolbar topbar tracking widget widgets"
)
#: What may stand beside such a word in a name: a name with any other word is a topic's, not furniture's.
LAYOUT = (
    "area article articles author avatar bar block blog body bottom box button buttons col column container content count date entries entry global google group header icon icons image inner item items label left link links list logo "
    "main media message messages meta mobile name outer page pane panel post posts primary reader readers region result results right row secondary section site slot stories story text title top trail unit user users view web wrap wrapper zone"
)
PARAGRAPHS = "p h1 h2 h3 h4 h5 h6 li dd dt blockquote pre td th figcaption caption"
ROLES = "navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar"

_raw, _furniture, _block, _names, _roles, _layout, _paragraphs = (frozenset(x.split()) for x in (RAW, FURNITURE, BLOCK, NAMES, ROLES, LAYOUT, PARAGRAPHS))
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<({'|'.join(sorted(_raw))})\b[^<>]*(?:/>|>(?:.*?</\1\s*>|.*\Z))"
    r"|<(/?)([a-zA-Z][^\s/<>]*)((?:[^<>\"']|\"[^\"<]*\"|'[^'<]*')*)>"
    r"|<[/!?a-zA-Z][^<>]*>",
    re.S | re.I,
)
_NAMED = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_LEGAL = re.compile(r"(?:copyright\s*(?:©|\(c\))?|©|\(c\))\s*\d{4}\b|©\s", re.I)


def is_furniture(name: str, attributes: str, in_article: bool) -> bool:
    """Whether an element holds something other than the article, by its name, class, id or role."""
    if name in _furniture and not (name == "header" and in_article):
        return True
    if name in ("html", "body", "main") or "=" not in attributes:
        return False
    for kind, *values in _NAMED.findall(attributes):
        for one in "".join(values).split():
            if kind.lower() == "role":
                if one.lower() in _roles:
                    return True
                continue
            parts = {x.lower() for x in _WORD.findall(one) if len(x) > 1}
            if parts & _names and parts <= _names | _layout or parts in ({"header"}, {"site", "header"}, {"page", "header"}):
                return True
    return False


class Line(NamedTuple):
    """A line's text, its length outside links, whether an article (2) or a main part (1) is around it, whether it is a paragraph or heading, and its article's number."""

    text: str
    length: int
    mark: int
    paragraph: bool
    article: int

    def legal(self) -> bool:
        """Whether this is a short line of copyright, such as stands below a text."""
        return self.length < SURGE and _LEGAL.match(self.text) is not None


def lines_of(page: str) -> list[Line]:
    """A page's lines, without furniture."""
    lines: list[Line] = []
    paragraph = False
    parts: list[str] = []
    linked = [0, 0]  # characters inside links, depth of links
    depth = dict.fromkeys(ARTICLE.split(), 0)
    articles = 0
    skip, skip_depth = "", 0
    last_close = {m[1].lower(): m.start() for m in re.finditer(r"</([a-zA-Z][^\s/<>]*)", page)}

    def flush() -> None:
        text = " ".join(entities.unescape("".join(parts)).split())
        if text:
            lines.append(Line(text, max(0, len(text) - linked[0]) if 2 * linked[0] <= len(text) else 0, 2 if depth["article"] else int(depth["main"] > 0), paragraph, articles if depth["article"] else 0))
        parts.clear()
        linked[0] = 0

    at = 0
    for m in _TOKEN.finditer(page):
        if not skip and m.start() > at:
            parts.append(page[at : m.start()])
            if linked[1]:
                linked[0] += m.start() - at
        at = m.end()
        name = (m[3] or "").lower()
        if not name:
            continue
        closing = bool(m[2])
        if skip == "p" and name in _block and not (closing and name == "p"):  # paragraphs hold no blocks: this one was left open
            skip = ""
        if skip:
            if name == skip and not m[4].endswith("/"):
                skip_depth += -1 if closing else 1
                if not skip_depth:
                    skip = ""
            continue
        if name in _block:
            flush()
            if name != "br":
                paragraph = name in _paragraphs and not closing
        if name == "a":
            linked[1] = 0 if closing else 1
        if not closing and is_furniture(name, m[4], depth["article"] > 0) and last_close.get(name, -1) > m.start():
            flush()
            skip, skip_depth = name, 1
        elif name in depth:
            articles += name == "article" and not closing and not depth[name]
            depth[name] = max(0, depth[name] - 1) if closing else depth[name] + 1
    if not skip:
        parts.append(page[at:])
    flush()
    return lines


def main_text(page: str | None) -> str:
    """The article of a page: one line for each block, found by surge and dive of the window sums."""
    lines = lines_of(page or "")
    sums = [sum(x.length for x in lines[i : i + WINDOW]) for i in range(len(lines))]
    best = max((x.mark for x in lines), default=0)
    needed = [SURGE << (best - x.mark) for x in lines]
    if not any(total >= least for total, least in zip(sums, needed, strict=True)):
        needed = [max(1, *sums)] * len(lines) if lines else []
    kept: list[str] = []
    i = end = 0
    while i < len(lines):
        if not lines[i].length or sums[i] < needed[i]:
            i += 1
            continue
        start = i
        while start > end and lines[start - 1].length and lines[start - 1].paragraph:
            start -= 1
        while i < len(lines) and (sums[i] or 0 < lines[i].article == lines[i - 1].article):
            i += 1
        end = i
        while not lines[end - 1].length:
            end -= 1
        most = max(x.mark for x in lines[start:end])
        outside = [x.legal() or x.length < (SURGE if x.mark < most else 0 if x.paragraph else SHORT) for x in lines[start:end]]
        inside = [k for k, out in enumerate(outside, start) if not out] or [start, end - 1]
        kept += [x.text for x in lines[inside[0] : inside[-1] + 1]]
    return "\n".join(kept)


def extract_text(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of every page. Needs no shuffle."""

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(main_text)

    return pages.select(id_column, url_column, text(F.coalesce(html_column, F.lit(""))).alias("text")).withColumn("n_chars", F.length("text").cast("long"))
