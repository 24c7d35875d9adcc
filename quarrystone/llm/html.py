"""HTML extraction by line-block distribution.

A page is stripped of markup into lines, one for each block of text in page
order. Markup serves as evidence only: a line inside an element that is
boilerplate by its tag, class, id or role weighs nothing at all and is no part
of the distribution, nor are lines outside the article of a page that marks
one; text inside links does not count either. The weights of the other lines
are summed over sliding windows. The text begins where a window surges and
ends where the last one dives; a stretch of windows without any weight between
them, such as a list of links, is left out. Short lines before the surge and
after the dive stay where they stand in the same container, the innermost
block around the lines that surge by themselves.

All passes take time in proportion to the page, whatever is left open in it.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Lines in a window, and the sum of weights above which a window counts as text.
WINDOW = 3
SURGE = 80

_NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
_STOP = re.compile(r"""=\s*+(["'])|>""")
_ATTR = re.compile(r"""(?<![a-zA-Z-])([a-zA-Z-]++)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++))""")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|display\s*+:\s*+none", re.I)
#: Elements whose content is no markup; it ends at the closing tag only.
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
_CLOSERS = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in sorted(RAW)}
DROPPED = frozenset("head nav footer aside form button select option menu dialog svg canvas object audio video map datalist".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An element of these ends where one of the named begins.
ENDED_BY = {"p": BLOCKS, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
READERS = frozenset("comment comments reply replies disqus respond".split())
#: Names that mark adverts, notices, menus, sidebars and comments, wherever they stand.
NOT_ARTICLE = READERS | frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense adslot sponsor sponsored banner cookie cookies consent gdpr notice notices "
    "sidebar menu menus menubar nav navbar navigation breadcrumb breadcrumbs masthead footer contentinfo".split()
)
#: Names that mark more: outside a marked article always, inside only what holds no paragraph, as buttons do not.
NOT_CONTENT = NOT_ARTICLE | frozenset(
    "promo promotion notification alert header share sharing social related recommended recommendations newsletter subscribe subscription signup login popup modal overlay "
    "toolbar pagination pager widget widgets skip copyright disclaimer complementary search dialog".split()
)
#: Words that say nothing by themselves in a name of several, so ``ad-box`` is an advert and ``related-work`` no widget.
NEUTRAL = frozenset(
    "area author bar big block body bottom box btn button buttons card col column container content count div element embed fixed form global google group holder info inner item items js "
    "label law left legal link links list main message meta msg outer page panel placeholder policy primary privacy reader readers region right row secondary section site slot small sticky "
    "text thread title top unit user users visitor wide wrap wrapper zone".split()
)
#: Words for the article itself: ``post-comments`` are comments, but ``post-header`` is a part of it.
ARTICLE_WORDS = frozenset("article blog entry news post story".split())
_PARTS = re.compile(r"[^a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre table dl".split())
#: Inside an article their ids are slugs of what they say.
NAMED_BY_TEXT = frozenset("h1 h2 h3 h4 h5 h6 p".split())


#: start, end, name (empty for comments and declarations), whether it closes, attributes, and where a raw element's
#: content begins and ends (such a tag goes on to the end of its closing tag). A plain tuple, as pages have many.
Tag = tuple[int, int, str, bool, str, tuple[int, int] | None]


def tags(page: str) -> Iterator[Tag]:
    """The tags of a page. From a tag that nothing ends on, the rest is text."""
    at, size, quoted = 0, len(page), True
    while (start := page.find("<", at)) >= 0:
        kind = page[start + 1 : start + 2]
        if kind in ("!", "?"):
            opener, closer = next((x for x in (("<!--", "-->"), ("<![CDATA[", "]]>")) if page.startswith(x[0], start)), ("", ">"))
            end = page.find(closer, start + len(opener))
            if end < 0 and not opener:
                return
            at = end + len(closer) if end >= 0 else size
            yield start, at, "", False, "", None
            continue
        closing = kind == "/"
        name = _NAME.match(page, start + 1 + closing)
        if not name:
            at = start + 1
            continue
        end = _tag_end(page, name.end()) if quoted else -1
        if end < 0:
            # Quotes that do not close: from here on a tag ends at the first bracket.
            quoted = False
            end = page.find(">", start)
            if end < 0:
                return
        at = end + 1
        tag, attrs, inner = name[0].lower(), page[name.end() : end], None
        if tag in RAW and not closing and not attrs.endswith("/"):
            stop = _CLOSERS[tag].search(page, at)
            inner = (at, stop.start() if stop else size)
            at = (page.find(">", stop.end()) + 1 if stop else 0) or size
        yield start, at, tag, closing, attrs, inner


def _tag_end(page: str, at: int) -> int:
    """Where the bracket is that ends a tag, not one in a quoted value."""
    end = page.find(">", at)
    if end < 0 or page.find("=", at, end) < 0:
        return end
    while m := _STOP.search(page, at):
        if not m[1]:
            return m.start()
        at = page.find(m[1], m.end()) + 1
        if not at:
            return -1
    return -1


def attributes(attrs: str) -> Iterator[tuple[str, str]]:
    for name, a, b, c in _ATTR.findall(attrs):
        yield name.lower(), a or b or c


def _named(attrs: str, names: frozenset[str], ids: bool = True) -> bool:
    """Whether class, id or role has one of the names, alone or with neutral words."""
    for name, value in attributes(attrs):
        if name in (("class", "id", "role") if ids else ("class", "role")):
            for word in value.split():
                parts = {x for x in _PARTS.split(_CAMEL.sub("-", word).lower()) if x and not x[0].isdigit()}
                found = parts & names
                if found and parts - names <= (NEUTRAL | ARTICLE_WORDS if found != {"header"} else NEUTRAL):
                    return True
    return False


def _boilerplate(tag: str, attrs: str, in_article: bool, paragraphs: bool = True) -> bool:
    if tag in DROPPED:
        return True
    if tag in ("html", "body"):
        return False
    if tag == "header":
        return not in_article
    if not attrs:
        return False
    if _HIDDEN.search(attrs):
        return True
    if tag in ("article", "main"):
        return _named(attrs, READERS)
    if in_article:
        return _named(attrs, NOT_ARTICLE if paragraphs or tag in PARAGRAPHS else NOT_CONTENT - {"header"}, ids=tag not in NAMED_BY_TEXT)
    return _named(attrs, NOT_CONTENT)


class Line(NamedTuple):
    text: str
    kept: bool  # in no boilerplate
    inside: bool  # in a marked article
    place: int  # the event at which it ends
    plain: int  # characters outside links


def _blocks(page: str, found: Iterable[Tag], at: int = 0) -> tuple[list[Line], list[tuple[int, int]]]:
    """The lines from ``at`` on, by the tags there, and (a, b) for each block element but the whole page: it holds the places over a, up to b."""
    # First the elements and where each ends, as tags may be left open.
    events: list[tuple[int, int, str, int, bool]] = []  # start, end, tag, element it opens or closes, opens
    closes: dict[int, int] = {}  # element (its event) -> event that ends it
    implied: set[int] = set()
    stack: list[tuple[str, int]] = []
    open_tags: dict[str, int] = {}
    attrs_of: dict[int, str] = {}

    def end(depth: int, event: int) -> None:
        while len(stack) > depth:
            tag, element = stack.pop()
            closes[element] = event
            open_tags[tag] -= 1

    for start, stop, tag, closing, attrs, inner in found:
        n = len(events)
        if not tag or inner:
            events.append((start, stop, "", -1, False))
            continue
        if closing:
            if open_tags.get(tag):
                depth = len(stack) - 1
                while stack[depth][0] != tag:
                    implied.add(stack[depth][1])
                    depth -= 1
                end(depth, n)
            events.append((start, stop, tag, -1, False))
            continue
        while stack and tag in ENDED_BY.get(stack[-1][0], ()):
            end(len(stack) - 1, n)
        events.append((start, stop, tag, n, True))
        if tag not in VOID and not (attrs.endswith("/") and tag not in BLOCKS):
            attrs_of[n] = attrs
            stack.append((tag, n))
            open_tags[tag] = open_tags.get(tag, 0) + 1
    implied.update(e for _, e in stack)
    end(0, len(events))
    # For each event the next that opens a paragraph.
    following = [len(events)] * (len(events) + 1)
    for i in range(len(events) - 1, -1, -1):
        following[i] = i if events[i][4] and events[i][2] in PARAGRAPHS else following[i + 1]
    out: list[Line] = []
    text: list[str] = []
    plain: list[str] = []
    dropped_to, article_to, link_to = -1, -1, -1

    def flush(event: int) -> None:
        if text and (got := " ".join(html.unescape("".join(text)).split())):
            weight = len(got) - got.count(" ") if len(plain) == len(text) else sum(map(len, html.unescape("".join(plain)).split()))
            out.append(Line(got, event > dropped_to, event <= article_to, event, weight))
        text.clear()
        plain.clear()

    for i, (start, stop, tag, element, opens) in enumerate(events):
        if start > at:
            part = page[at:start]
            text.append(part)
            if i > link_to:
                plain.append(part)
        at = stop
        if not tag:
            continue
        if tag == "br":
            text.append(" ")
            plain.append(" ")
        if tag == "a" and element in attrs_of:
            link_to = max(link_to, closes[element])
        if tag not in BLOCKS and element not in attrs_of and i not in (dropped_to, article_to):
            continue
        drops = opens and element in attrs_of and i > dropped_to and _boilerplate(tag, attrs_of[element], i <= article_to, following[i + 1] < closes[element])
        if tag in BLOCKS or drops or i in (dropped_to, article_to):
            flush(i)
        if not opens or element not in attrs_of:
            continue
        if drops:
            dropped_to = closes[element]
            if element in implied:  # left open: it goes no farther than the article
                marked = (j for j in range(i + 1, closes[element]) if events[j][4] and events[j][2] in ("article", "main") and not _boilerplate(events[j][2], attrs_of.get(j, ""), False))
                dropped_to = next(marked, closes[element]) - 1
        elif tag in ("article", "main") and i > dropped_to and closes[element] > article_to:
            article_to = closes[element]
    text.append(page[at:])
    if len(events) > link_to:
        plain.append(page[at:])
    flush(len(events))
    return out, [(e, closes[e]) for e in attrs_of if events[e][2] in BLOCKS and events[e][2] not in ("html", "body")]


def lines(page: str) -> list[tuple[str, bool, bool]]:
    """(text, kept, in article) for each block of text in page order; text has single spaces, references decoded."""
    return [found[:3] for found in _blocks(page, tags(page))[0]]


def body_lines(page: str, found: list[Tag]) -> list[str]:
    """All blocks of text from the end of the head on, boilerplate or not, by all tags of the page."""
    begin = next((i for i, t in enumerate(found) if (t[2] == "head" and t[3]) or (t[2] == "body" and not t[3])), 0)
    at = found[begin][0] if begin else 0
    return [line.text for line in _blocks(page, found[begin:], at)[0]]


def surge_and_dive(weights: list[int], window: int = WINDOW, surge: int = SURGE) -> tuple[int, int] | None:
    """The first line with weight from the first window over ``surge`` on, and the last up to the last such window; none if there is none."""
    total, dense = sum(weights[:window]), []
    for i in range(len(weights)):
        if total > surge:
            dense.append(i)
        total += (weights[i + window] if i + window < len(weights) else 0) - weights[i]
    if not dense:
        return None
    begin, end = dense[0], min(dense[-1] + window, len(weights)) - 1
    while not weights[begin]:
        begin += 1
    while not weights[end]:
        end -= 1
    return begin, end


def _valleys(weights: list[int], window: int) -> set[int]:
    """Lines of runs without weight that fill a window."""
    found: set[int] = set()
    start = 0
    for i in range(len(weights) + 1):
        if i == len(weights) or weights[i]:
            if i - start >= window:
                found.update(range(start, i))
            start = i + 1
    return found


def container(core: list[int], places: list[int], blocks: list[tuple[int, int]]) -> tuple[int, int] | None:
    """The innermost block that holds the core lines and at least one more."""
    first, last = places[core[0]], places[core[-1]]
    for a, b in sorted(((a, b) for a, b in blocks if a < first and last <= b), reverse=True):
        if bisect_right(places, b) - bisect_right(places, a) > core[-1] - core[0] + (len(core) == 1):
            return a, b
    return None


def main_lines(found: list[Line], blocks: list[tuple[int, int]], window: int = WINDOW, surge: int = SURGE) -> list[str]:
    """The lines between surge and dive, and those beside them that are text of the same container."""
    marked = any(line.kept and line.inside for line in found)
    own = [line for line in found if line.kept and (line.inside or not marked)]
    weights = [len(line.text) if marked else line.plain for line in own]
    if not (at := surge_and_dive(weights, window, surge)):
        return [line.text for line in own]
    begin, end = at
    valleys = _valleys(weights, window)
    core = [i for i in range(begin, end + 1) if weights[i] > surge] or [begin, end]
    places = [line.place for line in own]
    around = container(core, places, blocks)
    out = []
    for i, line in enumerate(own):
        if marked:
            stays = True
        elif core[0] <= i <= core[-1]:
            stays = i not in valleys
        elif around:
            stays = around[0] < line.place <= around[1] and weights[i] > 0
        else:
            stays = begin <= i <= end and i not in valleys
        if stays:
            out.append(line.text)
    return out


def extract_text(page: str | None) -> str:
    return "\n".join(main_lines(*_blocks(page, tags(page)))) if page else ""


def extract(pages: DataFrame, html_col: str = "html", out: str = "text") -> DataFrame:
    """Add ``out``, the main text of each page, from the whole html; null and empty pages give an empty text.

    Other columns, ``out`` apart, stay as they are; repeated rows are kept and
    an empty table gives an empty one. A page of any length, however broken,
    takes time in proportion to it.
    """

    @F.pandas_udf("string")
    def main_text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in batches:
            yield pd.Series([extract_text(p) for p in pages], dtype=object)

    # Not deterministic, as else a filter on the result would compute it twice.
    return pages.withColumn(out, main_text.asNondeterministic()(F.col(html_col)))


def op5_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
