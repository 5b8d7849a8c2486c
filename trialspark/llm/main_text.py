"""Main text of web pages by a maximum-scoring subsequence of their tokens.

Each page is a line of words and tags. Words score above zero and tags below, with weights learned from pages that mark
their article; one linear scan finds the contiguous region with the greatest sum. The registry has no page records, so
this operator is general: it works on any table of pages.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialspark.llm.html_tokens import BLOCK, VOID, names, squeeze, tokens

# Elements, and words in class, id and role values, that stand for something else than the article; and words that
# only say where or in what form an element stands. A name counts if all its words are of these two kinds, so that
# ``share-bar`` does and ``side-effects`` or ``legal-basis`` does not.
ASIDE_TAGS = frozenset(("aside", "button", "dialog", "footer", "form", "header", "menu", "nav", "select"))
ASIDE_WORD = re.compile(
    r"ads?|adverts?|advertisements?|advertising|sponsor(?:ed|s)?|promo(?:s|tions?|ted)?|banners?|nav|navbar|navigation|menus?|breadcrumbs?|sidebars?|side|widgets?"
    r"|footer|header|masthead|comments?|commentlist|disqus|respond|replies|reply|share|sharing|social|cookies?|consent|gdpr|notices?|alerts?|popups?|modal"
    r"|newsletter|subscribe|signup|login|search|related|recommended|toolbar|pagination|copyright|legal|skip|complementary|contentinfo")
PLACE_WORD = re.compile(
    r"\d+|box|bar|block|wrap|wrapper|container|list|item|items|inner|outer|section|area|unit|slot|panel|group|row|column|col|content|body|text|title|form|forms|link|links"
    r"|button|buttons|icon|icons|site|page|global|main|primary|secondary|top|bottom|left|right|mobile|desktop|fixed|sticky|floating|reader|readers|user|users"
    r"|article|articles|post|posts|blog|story|stories|thread|js|is|has|c|m|u")
KNOWN_TAGS = BLOCK | VOID | {"a", "b", "i", "em", "strong", "span", "u", "small", "sub", "sup", "code", "label", "q", "cite", "abbr", "time"}
WHOLE = frozenset(("html", "body", "main", "article"))  # never an aside for what their class says
MARKED = ("article", "main")
WORD_FLOOR, TAG_CEILING, TAG_FLOOR = 0.05, -0.05, -6.0


@lru_cache(4096)
def stands_aside(own: str) -> bool:
    """Whether one of these class, id and role values names something else than the article."""
    for name in own.split():
        words = [w for w in re.split(r"[_:-]+", name) if w]
        if any(ASIDE_WORD.fullmatch(w) for w in words) and all(ASIDE_WORD.fullmatch(w) or PLACE_WORD.fullmatch(w) for w in words):
            return True
    return False


def _kind(tag: str, aside: bool) -> str:
    return (tag if tag in KNOWN_TAGS else "?") + ("!" if aside else "")


def line(html: str) -> list[tuple[str, str, bool, int]]:
    """(kind, text, aside, words) of every tag and text run of a page, in page order.

    A text run has the kind of its innermost open element in front of a ``w``; ``aside`` tells that an open element
    stands for a menu, an advert and the like.
    """
    out, stack, asides, opened = [], [], 0, Counter()
    for what, value, rest in tokens(html):
        if what == "text":
            n = len(value.split())
            if n or out:
                out.append(("w" + (stack[-1][1] if stack else ""), value, asides > 0, n))
        elif what == "open":
            if value in BLOCK:  # a block ends the paragraph and the inline elements that were left open before it
                while stack and not stack[-1][2] and (stack[-1][0] == "p" or stack[-1][0] not in BLOCK):
                    opened[stack.pop()[0]] -= 1
            aside = value in ASIDE_TAGS or value not in WHOLE and bool(rest and (own := names(rest)) and stands_aside(own))
            kind = _kind(value, aside)
            if value not in VOID and not rest.endswith("/"):
                stack.append((value, kind, aside))
                opened[value] += 1
                asides += aside
            out.append(("<" + kind, value, asides > 0, 0))
        elif what == "close":
            kind, inside = _kind(value, False), asides > 0
            if opened[value]:
                while True:
                    tag, kind, aside = stack.pop()
                    opened[tag] -= 1
                    asides -= aside
                    if tag == value:
                        break
            out.append(("/" + kind, value, inside, 0))
    return out


def marked_region(parts: list[tuple[str, str, bool, int]]) -> tuple[int, int] | None:
    """The parts from the first ``article`` (or else ``main``) tag to its last end, if a page marks one."""
    for tag in MARKED:
        opens = [i for i, p in enumerate(parts) if p[0].startswith("<") and p[1] == tag and not p[2]]
        closes = [i for i, p in enumerate(parts) if p[0].startswith("/") and p[1] == tag]
        if opens and closes and closes[-1] > opens[0]:
            return opens[0], closes[-1]
    return None


def fit_weights(pages: DataFrame, *, html: str = "html") -> dict[str, float]:
    """Weight of every kind of token: the log odds of standing in the marked region of a page rather than outside.

    All pages with an ``article`` or ``main`` element teach. Words have a weight of at least ``WORD_FLOOR`` and at most 1,
    tags one of ``TAG_FLOOR`` to ``TAG_CEILING``. The kinds are a fixed set of tags, so the weights are small.
    """

    def count(batches):
        for batch in batches:
            total: dict[tuple[str, bool], int] = {}
            for page in batch.column(0).to_pylist():
                parts = line(page or "")
                if region := marked_region(parts):
                    for i, (kind, _, aside, n) in enumerate(parts):
                        if kind[0] != "w" or not aside:  # words that never come out score nothing and teach nothing
                            at = kind, region[0] <= i <= region[1]
                            total[at] = total.get(at, 0) + (n if kind[0] == "w" else 1)
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in total], pa.string()), pa.array([i for _, i in total], pa.bool_()), pa.array(list(total.values()), pa.int64())], ["kind", "inside", "n"])

    rows = pages.select(html).mapInArrow(count, "kind string, inside boolean, n bigint").groupBy("kind").agg(
        F.sum(F.when(F.col("inside"), F.col("n")).otherwise(0)).alias("i"), F.sum(F.when(F.col("inside"), 0).otherwise(F.col("n"))).alias("o")).collect()
    weights = {}
    for r in rows:
        odds = log((r.i + 1) / (r.o + 1))
        weights[r.kind] = max(WORD_FLOOR, min(1.0, odds)) if r.kind[0] == "w" else min(TAG_CEILING, max(TAG_FLOOR, odds))
    return weights


def _default(kind: str) -> float:
    """The weight of a kind that no labelled page has."""
    if kind[0] == "w":
        return 0.5
    return TAG_FLOOR if kind.endswith("!") else -0.5


def best_region(scores: list[float]) -> tuple[int, int]:
    """Start and end of the contiguous run with the greatest sum above zero, the first and shortest of equals."""
    best, where, here, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if here <= 0:
            here, start = 0.0, i
        here += s
        if here > best:
            best, where = here, (start, i + 1)
    return where


def main_text(html: str, weights: dict[str, float]) -> str:
    """The blocks of the best region of a page, joined by an empty line."""
    parts = line(html)
    scores = []
    for kind, _, aside, n in parts:
        weight = weights.get(kind)
        weight = _default(kind) if weight is None else weight
        scores.append(weight * (0 if aside else n) if kind[0] == "w" else weight)  # only words that come out count
    start, stop = best_region(scores)
    blocks, now = [], []
    for kind, value, aside, _ in parts[start:stop]:
        if kind[0] == "w":
            if not aside:
                now.append(value)
        elif value == "br":
            now.append(" ")
        elif value in BLOCK:
            blocks.append(squeeze("".join(now)))
            now = []
    blocks.append(squeeze("".join(now)))
    return "\n\n".join(b for b in blocks if b)


def extract_main_text(pages: DataFrame, *, key: str = "page_id", url: str = "url", html: str = "html", weights: dict[str, float] | None = None) -> DataFrame:
    """``key``, ``url`` and ``text`` of every page: its article without menus, adverts, comments and the like.

    Character references are decoded, white space inside a block becomes one space, blocks are joined by two line feeds in
    page order. Without ``weights`` they are fitted on the pages at hand first, by a Spark job over all of them; pages
    without a marked article, or none at all, leave unknown kinds at fixed weights.

    A null or empty page, and one without words, gives an empty text; unclosed tags end with their parents; repeated rows
    are worked on each; extra columns are ignored; an empty table gives an empty result.
    """
    own = pages.select(F.col(key).alias("k"), F.col(url).alias("u"), F.col(html).alias("h"))
    known = fit_weights(own, html="h") if weights is None else weights

    def extract(batches):
        for batch in batches:
            texts = [main_text(page or "", known) for page in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["k", "u", "text"])

    found = own.mapInArrow(extract, f"k {own.schema['k'].dataType.simpleString()}, u {own.schema['u'].dataType.simpleString()}, text string")
    return found.select(F.col("k").alias(key), F.col("u").alias(url), "text")
