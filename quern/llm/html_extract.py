"""HTML extraction by the distribution of line blocks.

Markup is stripped, with the text of elements that never hold the main text
(scripts, navigation, footers, what is named as an advertisement), so that
every block-level element begins a line. The block
of a line is the text length of a window of lines that begins there. Text is
kept from where the distribution surges (a block above a threshold whose
successors aren't empty) to where it dives (a block that is empty or small),
for every such stretch of the page. Where nothing surges, as on a page of a
few short paragraphs, half of the page's greatest block is the threshold.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import importable, table

WINDOW = 3
#: Characters in a window at which text surges, and below which it dives.
SURGE, DIVE = 86, 8

_DROP = frozenset("script style noscript template nav footer aside svg iframe select button".split())
#: Elements whose content is no markup.
_RAW = frozenset(("script", "style"))
_FIELD = frozenset("label legend textarea a".split())
_META = frozenset("base link meta title".split())
#: What can't be in a head: its closing tag may be left out.
_BODY = frozenset("address article aside blockquote body center div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr img main nav ol p pre section table ul".split())
_BLOCK = frozenset("address article aside blockquote body br center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
_ADS = frozenset("ad ads advert adverts advertisement banner breadcrumb breadcrumbs cookie cookies menu nav navbar pagination promo related share sidebar social sponsored".split())
_NAMEABLE = frozenset("div section ul p span table".split())
_OPEN = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][a-zA-Z0-9:-]*))")
_CLOSE = {n: re.compile(rf"</{n}\s*>", re.I) for n in _RAW}
_PLAIN = re.compile(r"[^>\"']*")
_NAME = re.compile(r"\b(?:class|id)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_APART = re.compile(r"[\s_-]+")
_SPACE = re.compile(r"[ \t\r\f\v\xa0]+")
_BLANK = re.compile(r"[\s\xa0]+")


class Tag(NamedTuple):
    """``name`` is in lower case, and empty for a comment, a declaration or the content of a script."""

    name: str
    closing: bool
    start: int
    end: int
    text: str


def tags_of(page: str) -> list[Tag]:
    """All tags, comments and declarations, in one scan: what has been looked for in vain isn't looked for again."""
    found: list[Tag] = []
    at, last, quoted = 0, page.rfind(">"), True
    while (m := _OPEN.search(page, at)) and m.start() < last:
        start, at = m.span()
        if m[1]:
            end = page.find("-->", at)
            at = end + 3 if end >= 0 else len(page)
            found.append(Tag("", False, start, at, ""))
            continue
        end = at
        while quoted and not m[2]:  # to the first ">" that isn't in quotes
            end = _PLAIN.match(page, end).end()
            if end >= len(page):
                quoted = False
            elif page[end] == ">":
                break
            elif (end := page.find(page[end], end + 1) + 1) == 0:
                quoted = False
        if not quoted or m[2]:
            end = page.find(">", at)
            if end < 0:
                break
        name = (m[4] or "").lower()
        found.append(Tag(name, bool(m[3]), start, end + 1, page[at:end]))
        at = end + 1
        if name in _RAW and not m[3]:
            close = _CLOSE[name].search(page, at)
            found[-1] = Tag("", False, start, close.end() if close else len(page), "")
            at = found[-1].end
    return found


def _partners(tags: list[Tag]) -> tuple[dict[int, int], set[int]]:
    """Which tag closes which, and the opening ones that have another of their kind in them."""
    closed, nested, open_ = {}, set(), {}
    for i, t in enumerate(tags):
        if not t.name:
            continue
        own = open_.setdefault(t.name, [])
        if not t.closing:
            if own:
                nested.add(own[-1])
            own.append(i)
        elif own:
            closed[own.pop()] = i
    return closed, nested


def _head_end(page: str, tags: list[Tag], i: int, closed: dict[int, int], body: np.ndarray) -> int:
    """The tag that ends a head: the one that closes it, or the last before the first thing that can't be in it."""
    end = closed.get(i)
    if end is not None and body[end] == body[i + 1]:
        return end
    last, j, upto = i, i + 1, len(tags) if end is None else end
    while j < upto and (tags[j].name in _META or not tags[j].name):
        between = page[tags[j - 1].end : tags[j].start]
        if between.strip() and not (tags[j].name == "title" and tags[j].closing):
            break
        last, j = j, j + 1
    return last


def _named(tag: Tag) -> bool:
    """Whether its class or id names an element as an advertisement or a list of links."""
    return any(not _ADS.isdisjoint(_APART.split((m[1] or m[2] or m[3] or "").lower())) for m in _NAME.finditer(tag.text))


def lines_of(page: str) -> tuple[list[str], list[int]]:
    """The text of each line of a page without its markup, and how much of it isn't the text of links.

    Left out are elements of ``_DROP``, small ones (closed, with none of their
    kind in them) that their class or id names as an advertisement or a list
    of links, the head, and forms that don't hold most of the page's text.
    """
    tags = tags_of(page)
    closed, nested = _partners(tags)
    n = len(tags)
    # Text k lies before tag k. Differences: where texts begin and cease to be left out, in a field, in a link.
    out, field, link = np.zeros(n + 2, np.int32), np.zeros(n + 2, np.int32), np.zeros(n + 2, np.int32)
    forms, body = [], None
    for i, t in enumerate(tags):
        if t.closing or not t.name:
            continue
        end = closed.get(i)
        if t.name == "head":
            if body is None:  # how many opening tags before each can't be in a head
                body = np.cumsum([0, *((t.name in _BODY or t.name == "head") and not t.closing for t in tags)])
            end = _head_end(page, tags, i, closed, body)
        elif end is None:
            if t.name == "form":
                forms.append((i, n))
            continue
        elif t.name == "form":
            forms.append((i, end))
            continue
        elif t.name in _FIELD:
            field[[i + 1, end + 1]] += (1, -1)
            if t.name == "a":
                link[[i + 1, end + 1]] += (1, -1)
            continue
        elif not (t.name in _DROP or t.name in _NAMEABLE and i not in nested and _named(t)):
            continue
        out[[i + 1, end + 1]] += (1, -1)
    gone, linked = np.cumsum(out) > 0, np.cumsum(link) > 0
    edge = [0, *(t.end for t in tags)]
    texts = [page[a:b] for a, b in zip(edge, [*(t.start for t in tags), len(page)])]
    if forms:
        size = np.array([len(_BLANK.sub("", x)) for x in texts], np.int64)
        upto = np.concatenate([[0], np.cumsum(np.where(gone[: n + 1] | (np.cumsum(field)[: n + 1] > 0), 0, size))])
        for i, end in forms:
            if 2 * (upto[end + 1 if end < n else n + 1] - upto[i + 1]) <= upto[-1]:
                gone[i + 1 : end + 1] = True
    lines: list[str] = []
    weights: list[int] = []
    parts: list[str] = []
    weight = 0

    def close() -> None:
        nonlocal weight
        lines.append(_SPACE.sub(" ", "".join(parts)).strip())
        weights.append(weight)
        parts.clear()
        weight = 0

    for k, text in enumerate(texts):
        if k and (tags[k - 1].name in _BLOCK or not tags[k - 1].name or gone[k] != gone[k - 1]):
            close()
        if gone[k] or not text:
            continue
        if "&" in text:
            text = html.unescape(text)
        text = text.replace("\n", " ")
        parts.append(text)
        if not linked[k]:
            weight += len(_BLANK.sub("", text))
    close()
    return lines, weights


def blocks_of(weights: list[int], window: int = WINDOW) -> np.ndarray:
    """The summed weight of each line and those after it, ``window`` in all."""
    sums = np.concatenate([[0], np.cumsum(weights, dtype=np.int64)])
    at = np.arange(len(weights))
    return sums[np.minimum(at + window, len(weights))] - sums[at]


def stretches(blocks: np.ndarray, surge: int = SURGE, dive: int = DIVE, window: int = WINDOW) -> list[tuple[int, int]]:
    """(first, last) line of each stretch between a surge and the dive after it."""
    found, i, n = [], 0, len(blocks)
    while i < n:
        if blocks[i] >= surge and (i + 1 >= n or blocks[i + 1 : i + window].max() > 0):
            j = i
            while j < n and blocks[j] >= dive:
                j += 1
            found.append((i, j - 1))
            i = j
        i += 1
    return found


def extract(page: str | None, surge: int = SURGE, dive: int = DIVE, window: int = WINDOW) -> str | None:
    """The main text, a line for each block; null for null, empty where no text is left but that of links."""
    if page is None:
        return None
    lines, weights = lines_of(page)
    # Empty lines only separate: the windows run over lines that hold text.
    kept = [(t, w) for t, w in zip(lines, weights) if t]
    if not kept:
        return ""
    texts, weights = zip(*kept)
    out = []
    blocks = blocks_of(list(weights), window)
    found = stretches(blocks, surge, dive, window)
    if not found and (greatest := int(blocks.max())):  # a short page: what surges is told by its own greatest block
        surge = max(1, min(surge, greatest // 2))
        at = int(blocks.argmax())
        found = stretches(blocks, surge, min(dive, surge), window) or [(at, min(at + window, len(texts)) - 1)]
    for a, b in found:
        # A window that surges begins at most window - 1 lines before the text does.
        while a < b and weights[a] < dive and weights[a] * 4 < max(weights[a : a + window]):
            a += 1
        out += texts[a : b + 1]
    return "\n".join(out)


def extracted(**limits: int) -> Callable[[Column], Column]:
    @F.pandas_udf("string")
    def text(pages: pd.Series) -> pd.Series:
        return pd.Series([extract(p, **limits) for p in pages.tolist()], dtype=object)

    return text


def extract_pages(pages: DataFrame, **limits: int) -> DataFrame:
    """``(page_id, url, text, n_chars)`` for every row of ``pages``.

    A null page gives a null text and 0 characters, a page of links alone an
    empty text. Broken markup is read as far as it goes: a comment or script
    that isn't closed ends with the page, another element that isn't closed
    keeps its text, and so does what looks like a tag but doesn't end. Any
    page takes time in proportion to its length. Repeated rows are extracted each, other columns
    are left out, an empty table gives none.
    """
    importable(pages.sparkSession)
    out = pages.select("page_id", "url", extracted(**limits)(F.col("html")).alias("text"))
    return out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("bigint"))


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))
