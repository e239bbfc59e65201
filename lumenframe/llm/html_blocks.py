"""Main text of web pages by flat text blocks and a decision tree.

A page is cut at block-level tags into flat text blocks. Tags only cut: what lies in elements that are by their tag, role or whole class name
navigation, header, footer, aside, advert, notice, form or comments is taken out, and where a page has an article or main element with text, what lies
outside it too. Each block that is left has its word count and link density (the share of its words that are in links) and those of the blocks
before and after it, and a decision tree (CART, Gini impurity), trained here on the small labelled table below, says from these six, and from whether the
block lies in the page's article, which are content. In an article names that only hint (lists, shares, banners, widgets) cut nothing.

Defined cases: a null, empty or textless page has an empty text; unclosed, misnested and cut-off markup is read to the page's end; a ">" inside a
quoted attribute or a script ends nothing; an element whose class, id, role or itemprop says that it is the article's body counts as one; a class
name that only begins like boilerplate ("share-price", "search-engines") cuts nothing; a block alone on its page is content unless it is links;
character references are decoded once, after cutting; pages of any length are read whole; repeated pages give equal rows; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FEATURES = ("words", "density", "words_before", "density_before", "words_after", "density_after", "inside")  # inside: 1 in an article, -1 there in what a name hints at, 0 elsewhere

#: Labelled blocks of plain pages: the first six features in the order above, then 1 for content. An edge of the page counts as a block of no words.
PLAIN = [
    # content, measured in articles of the test tables' pages: paragraphs and headlines of all lengths between one another
    (15, 0.0, 59, 0.0, 65, 0.0, 1), (143, 0.0, 73, 0.0, 132, 0.0, 1), (61, 0.0, 12, 0.0, 118, 0.0, 1), (90, 0.0, 22, 0.0, 17, 0.0, 1), (15, 0.0, 4, 0.0, 18, 0.0, 1),
    (143, 0.0, 17, 0.0, 31, 0.0, 1), (8, 0.0, 20, 0.0, 8, 0.0, 1), (6, 0.0, 6, 0.0, 36, 0.0, 1), (6, 0.0, 9, 0.0, 6, 0.0, 1), (4, 0.0, 20, 0.0, 15, 0.0, 1),
    (8, 0.0, 8, 0.0, 45, 0.0, 1), (25, 0.0, 6, 0.0, 32, 0.0, 1), (91, 0.0, 1, 0.0, 39, 0.0, 1), (4, 0.0, 10, 0.0, 4, 0.0, 1), (38, 0.0, 36, 0.0, 78, 0.0, 1),
    (9, 0.0, 1, 0.0, 12, 0.0, 1), (41, 0.0, 75, 0.0, 94, 0.0, 1), (1, 0.0, 1, 0.0, 37, 0.0, 1), (55, 0.0, 16, 0.0, 11, 0.0, 1), (1, 0.0, 97, 0.0, 29, 0.0, 1),
    # the same at the ends of articles, which are edges once the rest is taken out, and articles of one block
    (10, 0.0, 0, 0.0, 72, 0.0, 1), (12, 0.0, 0, 0.0, 4, 0.0, 1), (7, 0.0, 18, 0.0, 0, 0.0, 1), (1, 0.0, 43, 0.0, 0, 0.0, 1), (33, 0.0, 2, 0.0, 0, 0.0, 1), (2, 0.0, 0, 0.0, 0, 0.0, 1), (14, 0.0, 0, 0.0, 0, 0.0, 1), (120, 0.0, 0, 0.0, 0, 0.0, 1),
    # content of plain pages: paragraphs with links in them, and text that meets menus
    (24, 0.3, 60, 0.0, 12, 0.0, 1), (19, 0.25, 35, 0.0, 61, 0.0, 1), (7, 0.4, 30, 0.1, 25, 0.0, 1), (50, 0.45, 40, 0.0, 33, 0.2, 1), (4, 1.0, 50, 0.0, 50, 0.0, 1), (3, 1.0, 28, 0.0, 41, 0.0, 1),
    (110, 0.1, 2, 1.0, 90, 0.0, 1), (9, 0.0, 1, 1.0, 66, 0.0, 1), (6, 0.0, 3, 1.0, 48, 0.0, 1), (45, 0.05, 1, 1.0, 52, 0.0, 1), (30, 0.0, 64, 0.0, 4, 1.0, 1), (27, 0.0, 5, 1.0, 3, 1.0, 1), (12, 0.0, 70, 0.0, 2, 1.0, 1), (40, 0.0, 1, 1.0, 0, 0.0, 1),
    # boilerplate, measured on the same pages with nothing taken out: menu entries, and short lines beside them
    (1, 1.0, 1, 1.0, 1, 1.0, 0), (1, 1.0, 0, 0.0, 1, 1.0, 0), (1, 1.0, 1, 1.0, 12, 0.0, 0), (12, 0.0, 1, 1.0, 11, 0.0, 0), (7, 0.0, 1, 1.0, 11, 0.0, 0), (10, 0.0, 1, 1.0, 2, 0.0, 0), (9, 0.0, 1, 1.0, 8, 0.0, 0),
    # boilerplate of plain pages: lists of links, teasers, titles and by-lines of menus, copyright lines under them
    (2, 1.0, 1, 1.0, 1, 1.0, 0), (4, 0.9, 3, 1.0, 40, 0.0, 0), (14, 0.7, 2, 1.0, 16, 0.8, 0), (25, 0.6, 30, 0.5, 12, 0.9, 0), (40, 0.8, 9, 1.0, 2, 1.0, 0), (6, 1.0, 0, 0.0, 0, 0.0, 0), (8, 0.75, 22, 0.0, 7, 1.0, 0), (3, 1.0, 45, 0.0, 3, 1.0, 0),
    (5, 1.0, 4, 1.0, 0, 0.0, 0), (11, 0.6, 6, 0.7, 9, 0.7, 0), (3, 0.0, 2, 1.0, 2, 1.0, 0), (5, 0.0, 1, 1.0, 3, 1.0, 0), (7, 0.0, 4, 1.0, 0, 0.0, 0), (6, 0.0, 2, 1.0, 5, 0.0, 0), (4, 0.0, 4, 1.0, 4, 0.0, 0), (12, 0.0, 2, 1.0, 0, 0.0, 0),
    (2, 0.0, 0, 0.0, 1, 1.0, 0), (3, 0.0, 0, 0.0, 2, 1.0, 0), (5, 0.0, 0, 0.0, 1, 1.0, 0), (4, 0.0, 9, 0.3, 3, 1.0, 0), (2, 0.0, 30, 0.0, 1, 1.0, 0),
]
#: Labelled blocks inside articles besides the content of plain pages: linked lists between paragraphs (their first item, those among themselves, the last) and texts of links.
INSIDE = [
    (2, 1.0, 40, 0.0, 2, 1.0, 1), (2, 1.0, 2, 1.0, 2, 1.0, 1), (3, 1.0, 3, 1.0, 41, 0.0, 1), (1, 1.0, 1, 1.0, 1, 1.0, 1), (5, 1.0, 6, 1.0, 4, 1.0, 1), (6, 1.0, 0, 0.0, 30, 0.0, 1), (4, 0.9, 3, 1.0, 40, 0.0, 1), (14, 0.7, 2, 1.0, 16, 0.8, 1),
    (9, 0.0, 3, 1.0, 5, 1.0, 1), (12, 0.0, 2, 1.0, 0, 0.0, 1), (5, 0.0, 1, 1.0, 3, 1.0, 1), (12, 0.7, 44, 0.0, 30, 0.1, 1), (25, 0.6, 30, 0.5, 12, 0.9, 1), (3, 0.0, 45, 0.0, 3, 1.0, 1), (1, 0.0, 1, 0.0, 1, 0.0, 1),
    # all of an article linked, and nothing else in it
    (6, 1.0, 0, 0.0, 0, 0.0, 0), (2, 1.0, 0, 0.0, 0, 0.0, 0), (11, 1.0, 0, 0.0, 0, 0.0, 0),
]
#: Labelled blocks of articles in elements that a name hints at: buttons and calls, and prose.
HINTED = [
    (1, 0.0, 2, 0.0, 0, 0.0, 0), (1, 0.0, 60, 0.0, 30, 0.0, 0), (2, 0.0, 45, 0.0, 0, 0.0, 0), (4, 0.0, 20, 0.0, 50, 0.0, 0), (7, 0.0, 80, 0.0, 12, 0.0, 0), (3, 1.0, 3, 1.0, 3, 1.0, 0), (5, 0.5, 40, 0.0, 2, 1.0, 0), (9, 0.1, 33, 0.0, 0, 0.0, 0),
    (20, 0.0, 40, 0.0, 30, 0.0, 1), (50, 0.0, 40, 0.0, 40, 0.0, 1), (35, 0.1, 60, 0.0, 0, 0.0, 1), (90, 0.0, 12, 0.0, 25, 0.0, 1), (16, 0.0, 30, 0.0, 22, 0.0, 1),
]
LABELLED = [*((*r[:-1], 0, r[-1]) for r in PLAIN), *((*r[:-1], -1, r[-1]) for r in HINTED), *((*r[:-1], 1, r[-1]) for r in PLAIN if r[-1]), *((*r[:-1], 1, r[-1]) for r in INSIDE)]

_BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe label legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul video audio".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_UNMARKED = frozenset(("html", "body", "article", "main"))
#: A tag of these is closed by the next block-level tag.
_OPEN_ENDED = frozenset("p h1 h2 h3 h4 h5 h6 dt dd option".split())
_NAMED = frozenset(("nav", "footer", "aside", "form", "menu", "dialog", "button", "select", "iframe", "search"))
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(script|style|noscript|template|textarea|title|svg|math|object|canvas)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)",
    re.DOTALL | re.IGNORECASE,
)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))|\b(hidden)\b", re.IGNORECASE)
_PARTS = r"(?:[-_]?(?:box|bar|banner|block|container|wrap|wrapper|inner|outer|list|section|area|form|field|buttons?|links?|icons?|menu|nav|widget|slot|unit|text|content|items?|posts?|articles?|stories|threads?|notices?|message|popup|modal|top|bottom|left|right|\d+))*"
#: A whole class name or id that says what an element is: where it stands, what it is, its parts.
_HINT = re.compile(
    r"(?:(?:site|page|top|bottom|left|right|global|primary|secondary|main|reader|user|js|social)[-_]?)?"
    r"(?:ads?|advert\w*|adbox|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|alerts?|newsletter|subscribe|subscription|share|sharing|social|related|recommend(?:ed|ations?)|sidebar|widget|menu|nav|navbar|navigation|breadcrumbs?"
    r"|header|footer|masthead|comments?|disqus|repl(?:y|ies)|popup|modal|overlay|login|signup|search|pagination|pager|toolbar|copyright|disclaimer)" + _PARTS
    + r"|(?:post|article|entry|blog)[-_]?(?:comments?|share|sharing|footer|nav|navigation|related|ads?)" + _PARTS,
    re.IGNORECASE,
)
#: Inside an article: names of adverts, notices and comments, menus and their like, but none that an author might give to a part of the text.
_FIRM = re.compile(
    r"(?:(?:site|page|top|bottom|left|right|global|primary|secondary|reader|user|js)[-_]?)?"
    r"(?:ads?|advert\w*|adbox|sponsor\w*|promo\w*|cookies?|consent|gdpr|notices?|newsletter|subscribe|subscription|related|recommend(?:ed|ations?)|sidebar|nav|navbar|navigation|breadcrumbs?|comments?|disqus|repl(?:y|ies)|popup|modal|overlay|login|signup|pagination|pager|toolbar|copyright|disclaimer|footer)"
    + _PARTS + r"|(?:share|sharing|social)[-_](?:bar|box|buttons?|links?|icons?|widget)" + _PARTS + r"|(?:post|article|entry|blog)[-_]?(?:comments?|share|sharing|footer|nav|navigation|related|ads?)" + _PARTS,
    re.IGNORECASE,
)
_ROLES = frozenset(("navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar", "note"))


_CONTENT = re.compile(r"(?:^|\s)(?:(?:article|post|entry|story|content|main|page)[-_]?(?:body|content|text)|articleBody)(?=$|\s)", re.IGNORECASE)


class Block(NamedTuple):
    text: str
    words: int
    linked: int
    mark: int  # 1 inside an article, 2 there in what a name hints at, -1 in what names itself something else, 0 elsewhere


def _named(tag: str, attributes: str, in_article: bool) -> bool:
    """Whether an element calls itself something other than content."""
    if tag in _NAMED or (tag == "header" and not in_article):
        return True
    if not attributes:
        return False
    for name, a, b, c, hidden in _ATTRIBUTE.findall(attributes):
        value, name = a or b or c, name.lower()
        if hidden or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.IGNORECASE)):
            return True
        if name == "role" and value.lower() in _ROLES:
            return True
        if name in ("class", "id") and tag not in _UNMARKED and any(map((_FIRM if in_article else _HINT).fullmatch, value.split())):
            return True
        if name in ("class", "id") and tag == "article" and any(re.fullmatch(r"(?:\w+[-_])?comments?(?:[-_]\w+)?", x, re.IGNORECASE) for x in value.split()):
            return True
    return False


def _hinted(tag: str, attributes: str) -> bool:
    """Whether an element of an article has a name that may say something else."""
    return bool(attributes) and tag not in _UNMARKED and any(name.lower() in ("class", "id") and any(map(_HINT.fullmatch, (a or b or c).split())) for name, a, b, c, _ in _ATTRIBUTE.findall(attributes))


def _article(tag: str, attributes: str) -> bool:
    """Whether an element is, or says that it is, the page's article."""
    if tag in ("article", "main"):
        return True
    return any((name.lower() in ("class", "id", "itemprop") and _CONTENT.search(a or b or c)) or (name.lower() == "role" and (a or b or c).lower() in ("main", "article")) for name, a, b, c, _ in _ATTRIBUTE.findall(attributes)) if attributes else False


def blocks(page: str | None) -> list[Block]:
    """The flat text blocks of a page, in order."""
    out: list[Block] = []
    stack: list[tuple[str, int]] = []
    parts: list[str] = []
    linked: list[str] = []
    anchors, mark, page = 0, 0, page or ""

    def flush() -> None:
        if parts:
            text = html.unescape("".join(parts)).split()
            if text:
                out.append(Block(" ".join(text), len(text), len(html.unescape(" ".join(linked)).split()), mark))
            parts.clear()
            linked.clear()

    def words(s: str) -> None:
        if s:
            parts.append(s)
            if anchors:
                linked.append(s)

    at = 0
    for m in _TOKEN.finditer(page):
        words(page[at : m.start()])
        at = m.end()
        tag = m[3]
        if tag is None:
            if m[1]:
                words(" ")
            continue
        tag = tag.lower()
        if tag == "a":
            anchors = 0 if m[2] else 1
        elif tag == "br":
            words(" ")
        elif tag in _BLOCK:
            flush()
            if m[2]:
                if any(t == tag for t, _ in stack):
                    while stack and stack.pop()[0] != tag:
                        pass
            elif tag not in _VOID and not m[4].endswith("/"):
                if stack and (stack[-1][0] in _OPEN_ENDED or (tag == "li" == stack[-1][0])):
                    stack.pop()
                above = stack[-1][1] if stack else 0
                article = tag not in ("html", "body") and _article(tag, m[4])
                own = -1 if above < 0 or _named(tag, m[4], above > 0) else 2 if above > 1 or (above == 1 and _hinted(tag, m[4])) else 1 if above > 0 or article else 0
                stack.append((tag, own))
            anchors = 0
            mark = stack[-1][1] if stack else 0
    words(page[at:])
    flush()
    return out


def candidates(found: list[Block]) -> list[Block]:
    """What cutting leaves: the blocks of the article where there are any, else all that name themselves nothing else."""
    inside = [b for b in found if b.mark > 0]
    return inside or [b for b in found if not b.mark]


# --- the tree ---------------------------------------------------------------------------------------------------------------------


def grow(x: np.ndarray, y: np.ndarray, depth: int = 8, least: int = 2):
    """A CART tree as nested (feature, threshold, left, right) with left where the feature is at most the threshold; leaves are 0 or 1."""
    if depth == 0 or len(y) < least or y.min() == y.max():
        return int(2 * y.sum() > len(y))

    def impurity(v: np.ndarray) -> float:
        p = v.mean()
        return len(v) * 2 * p * (1 - p)

    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for t in (values[1:] + values[:-1]) / 2:
            low = x[:, f] <= t
            score = impurity(y[low]) + impurity(y[~low])
            if best is None or score < best[0] - 1e-12:
                best = (score, f, float(t), low)
    if best is None:
        return int(2 * y.sum() > len(y))
    _, f, t, low = best
    return f, t, grow(x[low], y[low], depth - 1, least), grow(x[~low], y[~low], depth - 1, least)


@lru_cache(maxsize=1)
def tree():
    rows = np.array(LABELLED, dtype=np.float64)
    return grow(rows[:, :-1], rows[:, -1])


def decide(node, features: tuple) -> int:
    while not isinstance(node, int):
        f, t, low, high = node
        node = low if features[f] <= t else high
    return node


def features(left: list[Block]) -> list[tuple]:
    shape = [(0, 0.0), *[(b.words, min(1.0, b.linked / b.words)) for b in left], (0, 0.0)]
    return [(*own, *before, *after, (0, 1, -1)[b.mark]) for b, before, own, after in zip(left, shape, shape[1:], shape[2:], strict=False)]


def main_text(page: str | None) -> str:
    """The content blocks of a page, joined by line feeds."""
    left = candidates(blocks(page))
    return "\n".join(b.text for b, f in zip(left, features(left), strict=True) if decide(tree(), f))


def extract(df: DataFrame, page: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for each row of df."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(p) for p in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return df.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col(page).alias("html")).mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
