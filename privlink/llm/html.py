"""Main-text extraction: flat text blocks, their word count and link density and those of their neighbours, classified by a
decision tree that is trained on the small labelled table below.

The tree asks for the text features first.  Facts about tags (inside ``article``, inside ``nav`` or ``form``) and names (class,
id, role) only split what these leave mixed; without any class and id the sample pages give the same text.

Block elements bound blocks; inline elements and ``<br>`` do not.  Inside a block white space becomes one space and
character references are decoded once.  Accepted blocks are joined by one line feed in page order.  A page is read in time
linear in its length.

Defined results: null or empty html gives an empty text; broken markup (unclosed elements, comments, quotes) is read as
far as it goes, and a tag without its end is text; repeated rows are answered row by row; an empty table gives an empty
table; other columns are not looked at.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import ship

# Names of HTML elements and the usual class, id and role words of page furniture.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
BOILER_TAGS = frozenset("nav footer aside menu dialog".split())
BOILER_WORDS = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs masthead footer contentinfo sidebar aside complementary ad ads advert adverts "
    "advertisement advertising sponsor sponsored promo banner cookie cookies consent gdpr notice notices alert popup modal "
    "overlay newsletter subscribe signup share sharing social related recommended comment comments reply replies respond "
    "disqus search login widget pagination pager copyright legal disclaimer toolbar skip".split()
)
MAIN_WORDS = frozenset("article main content post entry story body text".split())
RAW = "script|style|noscript|template|title|textarea|select|button|iframe|svg|object|canvas|xmp"

TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({RAW})\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>",
    re.DOTALL | re.IGNORECASE,
)
HINT = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
HIDDEN = re.compile(r"(?:^|\s)hidden(?=[\s/=]|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.IGNORECASE)

FEATURES = ("words", "links", "prev_words", "prev_links", "next_words", "next_links", "heading", "main", "furniture", "hinted")
#: The features of the text and its neighbours; facts about tags and names only split what these leave mixed.
TEXT_FEATURES = 7
#: The labelled table (fixed values): FEATURES, then 1 for main text.  First blocks of sample pages whose class and id attributes
#: were taken out, then blocks of kinds that these lack (comments, notices, forms, link lists within the article).
LABELLED = """
  1 1.00   0 0.00   1 1.00 0 0 1 0 0
  1 1.00   1 1.00   1 1.00 0 0 1 0 0
  1 1.00   1 1.00   4 0.00 0 0 1 0 0
  1 1.00   1 1.00   5 0.00 0 0 1 0 0
  1 1.00   1 1.00   6 0.00 0 0 1 0 0
  1 1.00   1 1.00   7 0.00 0 0 1 0 0
  1 1.00   1 1.00   8 0.00 0 0 1 0 0
  1 1.00   1 1.00   9 0.00 0 0 1 0 0
  1 1.00   1 1.00  10 0.00 0 0 1 0 0
  1 1.00   1 1.00  11 0.00 0 0 1 0 0
  1 1.00   1 1.00  12 0.00 0 0 1 0 0
  1 1.00   1 1.00  13 0.00 0 0 1 0 0
  4 0.00   1 1.00   7 0.00 0 0 0 0 0
  4 0.00   1 1.00   8 0.00 0 0 0 0 0
  4 0.00   1 1.00   9 0.00 0 0 0 0 0
  4 0.00   1 1.00  10 0.00 0 0 0 0 0
  4 0.00   1 1.00  11 0.00 0 0 0 0 0
  5 0.00   1 1.00   7 0.00 0 0 0 0 0
  5 0.00   1 1.00  11 0.00 0 0 0 0 0
  6 0.00   1 1.00   3 0.00 0 0 0 0 0
  7 0.00   1 1.00   5 0.00 0 0 0 0 0
  7 0.00   1 1.00   8 0.00 0 0 0 0 0
  7 0.00  36 0.00   0 0.00 0 0 1 0 0
  7 0.00  44 0.00   0 0.00 0 0 1 0 0
  8 0.00   1 1.00   3 0.00 0 0 0 0 0
  8 0.00   2 0.00   0 0.00 0 0 1 0 0
  8 0.00   4 0.00   0 0.00 0 0 1 0 0
  8 0.00   9 0.00   0 0.00 0 0 1 0 0
  8 0.00  33 0.00   0 0.00 0 0 1 0 0
  9 0.00   1 1.00   6 0.00 0 0 0 0 0
  9 0.00   1 1.00   9 0.00 0 0 0 0 0
  9 0.00   1 1.00  10 0.00 0 0 0 0 0
  9 0.00   1 1.00  11 0.00 0 0 0 0 0
  9 0.00   9 0.00   0 0.00 0 0 1 0 0
  9 0.00  17 0.00   0 0.00 0 0 1 0 0
  9 0.00  46 0.00   0 0.00 0 0 1 0 0
 11 0.00   1 1.00  10 0.00 0 0 0 0 0
 11 0.00   1 1.00  12 0.00 0 0 0 0 0
 11 0.00   8 0.00   0 0.00 0 0 1 0 0
 11 0.00 112 0.00   0 0.00 0 0 1 0 0
 12 0.00   1 1.00   1 0.00 0 0 0 0 0
 12 0.00   1 1.00   2 0.00 0 0 0 0 0
 12 0.00   1 1.00   8 0.00 0 0 0 0 0
 12 0.00   1 1.00   9 0.00 0 0 0 0 0
 12 0.00   1 1.00  12 0.00 0 0 0 0 0
 12 0.00  20 0.00   0 0.00 0 0 1 0 0
 13 0.00   1 1.00  10 0.00 0 0 0 0 0
 13 0.00   1 1.00  13 0.00 0 0 0 0 0
 13 0.00   4 0.00   0 0.00 0 0 1 0 0
 13 0.00  48 0.00   0 0.00 0 0 1 0 0
 13 0.00  61 0.00   0 0.00 0 0 1 0 0
 13 0.00  70 0.00   0 0.00 0 0 1 0 0
 14 0.00   8 0.00   0 0.00 0 0 1 0 0
 14 0.00   9 0.00   0 0.00 0 0 1 0 0
 14 0.00  11 0.00   0 0.00 0 0 1 0 0
 14 0.00  17 0.00   0 0.00 0 0 1 0 0
 15 0.00   5 0.00   0 0.00 0 0 1 0 0
 15 0.00  12 0.00   0 0.00 0 0 1 0 0
 15 0.00  58 0.00   0 0.00 0 0 1 0 0
 16 0.00  74 0.00   0 0.00 0 0 1 0 0
  2 0.00  22 0.00   5 0.00 0 1 0 0 1
  3 0.00  56 0.00  13 0.00 0 1 0 0 1
  3 0.00 226 0.00  42 0.00 0 1 0 0 1
  4 0.00   4 0.00  44 0.00 0 1 0 0 1
  4 0.00  12 0.00   4 0.00 1 1 0 0 1
  4 0.00  44 0.00   7 0.00 0 1 0 0 1
  5 0.00  83 0.00  18 0.00 0 1 0 0 1
  7 0.00  11 0.00   7 0.00 1 1 0 0 1
  7 0.00  13 0.00  58 0.00 0 1 0 0 1
  7 0.00 129 0.00  87 0.00 0 1 0 0 1
  8 0.00  13 0.00 114 0.00 1 1 0 0 1
  9 0.00   4 0.00   9 0.00 1 1 0 0 1
  9 0.00   8 0.00   9 0.00 1 1 0 0 1
  9 0.00   9 0.00   9 0.00 1 1 0 0 1
  9 0.00  12 0.00  31 0.00 1 1 0 0 1
 10 0.00   9 0.00  32 0.00 1 1 0 0 1
 10 0.00   9 0.00  63 0.00 1 1 0 0 1
 11 0.00   5 0.00  63 0.00 1 1 0 0 1
 11 0.00   6 0.00  11 0.00 1 1 0 0 1
 12 0.00   3 0.00  14 0.00 0 1 0 0 1
 12 0.00   4 0.00  25 0.00 1 1 0 0 1
 12 0.00  99 0.00  15 0.00 0 1 0 0 1
 13 0.00  13 0.00  25 0.00 1 1 0 0 1
 13 0.00  13 0.00  49 0.00 1 1 0 0 1
 13 0.00  33 0.00   9 0.00 0 1 0 0 1
 14 0.00   8 0.00  48 0.00 0 1 0 0 1
 16 0.00   2 0.00   1 0.00 0 1 0 0 1
 16 0.00  11 0.00  50 0.00 0 1 0 0 1
 16 0.00  18 0.00  24 0.00 0 1 0 0 1
 16 0.00 149 0.00  35 0.00 0 1 0 0 1
 21 0.00  47 0.00   2 0.00 0 1 0 0 1
 22 0.00   1 0.00  11 0.00 0 1 0 0 1
 24 0.00  19 0.00  14 0.00 0 1 0 0 1
 24 0.00 101 0.00  19 0.00 0 1 0 0 1
 28 0.00   4 0.00  55 0.00 0 1 0 0 1
 28 0.00  34 0.00   4 0.00 0 1 0 0 1
 28 0.00  59 0.00  11 0.00 0 1 0 0 1
 29 0.00 215 0.00   1 0.00 0 1 0 0 1
 31 0.00   8 0.00 134 0.00 0 1 0 0 1
 33 0.00  61 0.00   8 0.00 0 1 0 0 1
 35 0.00  10 0.00   1 0.00 0 1 0 0 1
 35 0.00  38 0.00  36 0.00 0 1 0 0 1
 37 0.00  25 0.00  25 0.00 0 1 0 0 1
 39 0.00  12 0.00  44 0.00 0 1 0 0 1
 46 0.00  26 0.00  39 0.00 0 1 0 0 1
 49 0.00  81 0.00   8 0.00 0 1 0 0 1
 55 0.00  47 0.00 122 0.00 0 1 0 0 1
 60 0.00  24 0.00  16 0.00 0 1 0 0 1
 61 0.00  17 0.00  41 0.00 0 1 0 0 1
 66 0.00  11 0.00  14 0.00 0 1 0 0 1
 67 0.00  53 0.00   9 0.00 0 1 0 0 1
 73 0.00   6 0.00  88 0.00 0 1 0 0 1
 79 0.00  10 0.00   7 0.00 0 1 0 0 1
 91 0.00  40 0.00  46 0.00 0 1 0 0 1
119 0.00  21 0.00  27 0.00 0 1 0 0 1
132 0.00   6 0.00  25 0.00 0 1 0 0 1
154 0.00   7 0.00  46 0.00 0 1 0 0 1
211 0.00  90 0.00  11 0.00 0 1 0 0 1
  1 0.00  10 0.00   8 0.00 0 1 0 0 1
  2 0.00  12 0.00 267 0.00 0 1 0 0 1
  2 0.00 109 0.00   8 0.00 0 1 0 0 1
  2 0.00  87 0.00  12 0.00 0 1 0 0 1
  1 0.00   4 0.00 253 0.00 0 1 0 0 1
  1 0.00  34 0.00  83 0.00 0 1 0 0 1
  1 0.00   8 0.00  12 0.00 0 1 0 0 1
  2 0.00   7 0.00  13 0.00 0 1 0 0 1
  9 0.00   1 1.00  20 0.00 0 0 0 0 0
 12 0.00   1 1.00  24 0.00 0 0 0 0 0
  8 0.00   1 1.00  18 0.00 0 0 0 0 0
  6 0.00   1 1.00  20 0.00 0 0 0 1 0
""" """
60 0.00  45 0.00  52 0.00 0 1 0 0 1
  2 0.00  60 0.00  40 0.00 0 1 0 0 1
  8 0.00   0 0.00   0 0.00 1 1 0 0 1
 90 0.00   1 1.00   6 0.00 0 1 0 0 1
  3 1.00   4 1.00   3 1.00 0 1 0 0 0
  9 0.90  50 0.00   7 1.00 0 1 0 0 0
  5 1.00  70 0.00  60 0.00 1 1 0 0 1
 60 0.00  45 0.00  50 0.00 0 0 0 0 1
 30 0.05  40 0.00  35 0.00 0 0 0 0 1
 45 0.10   2 1.00   3 1.00 0 0 0 0 1
 18 0.00  25 0.00  30 0.00 0 0 0 0 1
 14 0.00  60 0.00  50 0.00 0 0 0 0 1
  7 0.00   3 1.00  50 0.00 1 0 0 0 1
  5 0.00   2 1.00  30 0.00 1 0 0 0 1
  9 0.00  60 0.00  35 0.00 1 0 0 0 1
  3 0.00   2 0.00   2 1.00 1 0 0 0 0
  2 0.00   4 1.00   3 1.00 1 0 0 0 0
  4 0.00   3 0.00   5 0.00 0 0 0 0 0
  5 0.00   1 1.00   2 1.00 0 0 0 0 0
  8 0.00   4 0.00   0 0.00 0 0 0 0 0
  3 0.00   0 0.00   2 1.00 0 0 0 0 0
 11 0.00  12 0.00   6 0.00 0 1 0 0 1
 16 0.00  25 0.00  55 0.00 0 1 0 0 1
 21 0.00  10 0.00  60 0.00 0 1 0 0 1
 70 0.30  15 0.00  12 0.00 0 1 0 0 1
 17 0.00   0 0.00  13 0.00 0 1 0 0 1
 28 0.00  10 0.00  14 1.00 0 1 0 0 1
 19 0.00  90 0.00  18 0.00 0 1 0 0 1
  2 1.00   3 1.00   2 1.00 0 0 0 0 0
  9 0.80  20 0.00   6 1.00 0 0 0 0 0
 25 0.90  12 0.80  20 0.90 0 0 0 0 0
 40 0.70   8 1.00   9 1.00 0 0 0 0 0
 12 0.50   6 0.50   7 1.00 0 0 0 0 0
  6 0.00  50 0.00   0 0.00 0 0 0 0 0
  7 0.00   2 1.00   3 0.00 0 0 0 0 0
  2 0.00   9 0.00  25 0.00 0 0 0 1 0
  2 0.00  30 0.00  25 0.00 0 0 1 0 0
  2 0.00   2 0.00  25 0.00 1 1 0 1 0
  2 0.00  90 0.00   9 0.00 0 1 1 0 0
  4 0.00   9 0.00  40 0.00 0 0 0 1 0
  4 0.00  90 0.00  11 0.00 0 0 1 0 0
  4 0.00   5 0.00   2 0.00 0 1 0 1 0
  4 0.00  60 0.00  40 0.00 1 1 1 0 0
  8 0.00   2 0.00   2 0.00 0 0 0 1 0
  8 0.00   0 0.00   9 0.00 0 0 1 0 0
  8 0.00  13 0.00  11 0.00 0 1 0 1 0
  8 0.00  60 0.00  40 0.00 0 1 1 0 0
  9 0.00  60 0.00  11 0.00 0 0 0 1 0
  9 0.00  90 0.00   2 0.00 0 0 1 0 0
  9 0.00   2 0.00   0 0.00 1 1 0 1 0
  9 0.00   9 0.00   9 0.00 0 1 1 0 0
 14 0.00  60 0.00  80 0.00 0 0 0 1 0
 14 0.00  13 0.00  11 0.00 0 0 1 0 0
 14 0.00  60 0.00  25 0.00 0 1 0 1 0
 14 0.00  30 0.00  25 0.00 0 1 1 0 0
 22 0.00  60 0.00  25 0.00 0 0 0 1 0
 22 0.00   9 0.00   9 0.00 0 0 1 0 0
 22 0.00   0 0.00  80 0.00 0 1 0 1 0
 22 0.00  13 0.00  25 0.00 0 1 1 0 0
 30 0.00   5 0.00  40 0.00 0 0 0 1 0
 30 0.00  30 0.00  25 0.00 0 0 1 0 0
 30 0.00   2 0.00  40 0.00 0 1 0 1 0
 30 0.00   9 0.00  40 0.00 0 1 1 0 0
 45 0.00  13 0.00   9 0.00 0 0 0 1 0
  4 0.00  12 0.00  60 0.00 1 1 0 0 1
 12 0.00   1 0.00   9 0.00 1 1 0 0 1
  5 0.00  12 0.00  14 0.00 1 1 0 0 1
 11 0.00   8 0.00  40 0.00 1 1 0 0 1
  9 0.00  30 0.00   2 0.00 1 1 0 0 1
"""

#: How far the shares of the two labels lie apart in a nearly pure group.
PURE = 0.8


def train(rows: list[list[float]], leaf: int = 12, stage: int = 0):
    """A decision tree by Gini impurity: nested (feature, threshold, low, high), leaves are 0 or 1.

    Stage 0 takes the text features, as long as a split leaves a nearly pure group of at least ``leaf`` rows.  What remains mixed
    is split by the minor facts (stage 1) and, where these tell nothing either, by the text features again (stage 2).
    """

    def impurity(part):
        p = sum(r[-1] for r in part) / len(part)
        return len(part) * 2 * p * (1 - p)

    if len({r[-1] for r in rows}) == 1:
        return int(rows[0][-1])
    minor = range(TEXT_FEATURES, len(FEATURES))
    least = (leaf, 1, 3)[stage]
    best = None
    for f in minor if stage == 1 else range(TEXT_FEATURES):
        values = sorted({r[f] for r in rows})
        for a, b in zip(values, values[1:], strict=False):
            cut_at = (a + b) / 2
            low, high = [r for r in rows if r[f] <= cut_at], [r for r in rows if r[f] > cut_at]
            pure = [len(part) for part in (low, high) if abs(2 * sum(r[-1] for r in part) / len(part) - 1) >= PURE]
            if min(len(low), len(high)) < least or (stage == 0 and max(pure, default=0) < least):
                continue
            cost = impurity(low) + impurity(high)
            if stage == 0 and cost > 0.95 * impurity(rows):
                continue
            if best is None or cost < best[0] - 1e-12:
                best = (cost, f, cut_at, low, high)
    if best is None:
        return train(rows, leaf, stage + 1) if stage < 2 else int(2 * sum(r[-1] for r in rows) >= len(rows))
    _, f, cut_at, low, high = best
    return f, cut_at, train(low, leaf, stage), train(high, leaf, stage)


@functools.cache
def tree():
    return train([[float(x) for x in line.split()] for line in LABELLED.splitlines() if line.strip()])


def classify(node, features: tuple[float, ...]) -> int:
    while not isinstance(node, int):
        f, at, low, high = node
        node = low if features[f] <= at else high
    return node


def context(tag: str, attrs: str, main: bool, furniture: bool, hinted: bool) -> tuple[bool, bool, bool]:
    """Whether a block inside this element lies in the main part, in an element for page furniture, and in one named so."""
    words = frozenset()
    if attrs and "=" in attrs and tag not in ("html", "body"):
        words = frozenset(w for m in HINT.finditer(attrs) for w in re.split(r"[^a-z0-9]+", (m[1] or m[2] or m[3] or "").lower()))
    furniture = furniture or tag in BOILER_TAGS or tag == "form" or (tag == "header" and not main) or bool(attrs and HIDDEN.search(attrs))
    hinted = hinted or bool(words & BOILER_WORDS) or (not main and "header" in words)
    main = main or ((tag in ("article", "main") or bool(words & MAIN_WORDS)) and not (furniture or hinted))
    return main, furniture, hinted


def blocks(html: str) -> list[tuple[str, float, bool, bool, bool, bool]]:
    """(text, link density, heading, main, furniture, hinted) of each flat block, in time linear in the page."""
    out, buf, linked, link_at = [], [], 0, None
    stack: list[tuple[str, bool, bool, bool]] = []
    open_tags: Counter[str] = Counter()
    walls: list[int] = []  # places of block elements in the stack
    facts, heading = (False, False, False), False
    at, end = 0, html.rfind(">") + 1  # no tag ends behind the last ">"

    def flush():
        nonlocal buf, linked, link_at
        if buf:
            text = " ".join(unescape("".join(buf)).split())
            if link_at is not None:
                linked += len(unescape("".join(buf[link_at:])).split())
                link_at = 0
            if text:
                n = len(text.split(" "))
                out.append((text, min(1.0, linked / n), heading, *facts))
            buf, linked = [], 0

    def drop(place):
        for name, *_ in stack[place:]:
            open_tags[name] -= 1
        del stack[place:]
        while walls and walls[-1] >= place:
            walls.pop()

    for m in TOKEN.finditer(html, 0, end):
        if m.start() > at:
            buf.append(html[at : m.start()])
        at = m.end()
        name = m[3] or m[6]
        if name is None:
            if m[1]:
                flush()
            continue
        tag, closing, attrs = name.lower(), bool(m[2] or m[5]), m[4] or m[7] or ""
        if tag == "br":
            buf.append(" ")
            continue
        if tag not in INLINE:
            flush()
        if closing:
            if tag == "a" and link_at is not None:
                linked += len(unescape("".join(buf[link_at:])).split())
                link_at = None
            if open_tags[tag]:
                place = len(stack) - 1
                while stack[place][0] != tag:
                    place -= 1
                drop(place)
        else:
            if tag not in INLINE and walls:  # a new block ends an open paragraph; an item or cell ends its open sibling
                ends = (tag,) if tag in ("li", "dt", "dd", "td", "th", "tr", "option") else ("p",)
                if stack[walls[-1]][0] in ends:
                    drop(walls[-1])
            if tag not in VOID and not attrs.endswith("/"):
                if tag not in INLINE:
                    walls.append(len(stack))
                open_tags[tag] += 1
                stack.append((tag, *context(tag, attrs, *(stack[-1][1:] if stack else (False, False, False)))))
                if tag == "a":
                    link_at = len(buf)
        facts = stack[-1][1:] if stack else (False, False, False)
        heading = any(s[0] in ("h1", "h2", "h3", "h4", "h5", "h6") for s in stack[-3:])
    rest = html[max(at, end) :] if at <= end else html[at:]
    unclosed = re.search(rf"<!--|<(?:{RAW})\b", rest, re.IGNORECASE)
    buf.append(rest[: unclosed.start()] if unclosed else rest)
    flush()
    return out


def rows_of(found: list[tuple]) -> list[tuple[float, ...]]:
    """FEATURES of each block: its words and link density, those of both neighbours, whether it is a heading; then the minor facts."""
    sizes = [(0, 0.0), *((len(b[0].split(" ")), b[1]) for b in found), (0, 0.0)]
    return [(*sizes[i + 1], *sizes[i], *sizes[i + 2], *b[2:]) for i, b in enumerate(found)]


def main_text(html: str | None) -> str:
    found = blocks(html or "")
    return "\n".join(b[0] for b, row in zip(found, rows_of(found), strict=True) if classify(tree(), row))


def extract(df: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``keep`` with text and n_chars (its code points).  A narrow map; pages are read one at a time."""
    ship(df.sparkSession)
    picked = df.select(*keep, df[html_col].alias("__html"))
    schema = T.StructType([f for f in picked.schema if f.name != "__html"]).add("text", T.StringType()).add("n_chars", T.LongType())

    def run(batches):
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column(batch.num_columns - 1)]
            arrays = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(texts, type=pa.string()), pa.array([len(t) for t in texts], type=pa.int64())], names=[f.name for f in schema])

    return picked.mapInArrow(run, schema)
