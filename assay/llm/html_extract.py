"""Main-text extraction by a maximum-scoring contiguous region of a page's tokens.

A page is read once into tokens: runs of words, which score positive, and tags, which score negative. Each
token's chance of lying in the content is a naive Bayes estimate over what surrounds it: the nearest block
element, whether it is a link, how long its block is and how much of it is linked, and the elements, classes,
ids and roles around it. These weights are learned from labelled pages - those whose markup names the content
with an <article> or <main> element - and start from a prior: an element called like boilerplate (``DROPPED``,
``NAMES``, ``ROLES``) is unlikely to be content until pages say otherwise. A linear scan finds the contiguous
region with the largest sum; its scale of tags against words is chosen on the labelled pages, as they are and
with all names left out of account.

The text comes from the region: the blocks that it touches, but for those inside it that the same estimate puts
outside the content (adverts, asides, forms, comments); where it puts all of them outside, names alone decide. Where
one element other than the body holds the region, its further blocks join if the estimate puts them inside, so a
form in the middle does not cut off a short end. A class or id says nothing about what it merely wraps: an
element that holds an <article>, a <main> or more than half of the page's words is judged by the rest alone.

Defined cases: null and empty html give the empty string; character references are decoded, with or
without their semicolon as in HTML; unclosed and crossing elements are closed by their parents; unfinished
tags and comments at the end are markup; hidden elements, scripts and styles are never text; of equal regions
the first is taken; elements may nest, or stay open, to any depth, in linear time; pages of any length are read
whole; repeated rows are extracted alike; further columns may have any name.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from dataclasses import dataclass, field
from html import unescape

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fitting_rows, small_batches

#: Labelled pages that the weights are fitted on, and the most characters of these in all; the first of them choose the scale.
FIT_PAGES, FIT_CHARS, SCALE_PAGES = 2_000, 60_000_000, 300
#: Weight of tags against words, chosen on the labelled pages; of equals the first.
TAG_SCALES = (1.0, 2.0, 0.5, 4.0, 8.0)
#: Evidence that holds before anything is learned, in pages, and the prior chance of content inside an element called like boilerplate.
PRIOR, UNLIKELY = 4.0, 0.002
#: A sign's most log odds, whether it is of structure or of a name; log odds below which a block inside the region is left out.
MOST_LOCAL, MOST_NAMED, LEAVE_OUT = 3.0, 7.0, -1.0

#: Elements by role.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template textarea title iframe svg math object canvas audio video".split())
BLOCKS = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
DROPPED = RAW | set("head nav header footer aside form button select menu dialog datalist fieldset label input".split())
CLOSED_BY = {"p": BLOCKS - {"html", "body"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option", "optgroup"}}
ROLES = set("navigation banner contentinfo complementary search form menu menubar toolbar dialog alert alertdialog tooltip".split())
#: Words of a class or id that name boilerplate.
NAMES = set(
    "ad ads adv advert adverts advertisement advertising adsbox adbox banner billboard sponsor sponsored promo promotion nav navbar navigation navi menu submenu breadcrumb breadcrumbs toc pagination pager topbar header masthead footer foot sidebar side aside rail widget widgets related recommended recommendations "
    "cookie cookies consent gdpr notice notices notification notifications alert popup modal overlay lightbox subscribe subscription newsletter signup login signin register form search share sharing social follow comment comments commentlist reply replies respond disqus discussion feedback copyright legal disclaimer skip hidden".split()
)
#: Words that add nothing to such a name.
NEUTRAL = set("area bar block bottom box container content element group inner item items left link links list outer panel posts primary right secondary section site slot stories story top unit wrap wrapper zone".split())
_TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_NAME = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")
_CLOSERS: dict[str, re.Pattern] = {}


@dataclass
class Page:
    """Elements (nodes) and tokens of a page; a token is a run of words in a block, or a tag."""

    # nodes, in the order in which they open: parent, whether they frame the page, signs of their own, whether they are an <article> or <main>, called like boilerplate by a class
    parents: list[int] = field(default_factory=lambda: [-1])
    frames: list[bool] = field(default_factory=lambda: [True])
    signs: list[list[str]] = field(default_factory=lambda: [[]])
    marked: list[bool] = field(default_factory=lambda: [False])
    named: list[bool] = field(default_factory=lambda: [False])
    # tokens: sign (nearest block or tag name), words (0 for a tag), block, node
    kinds: list[str] = field(default_factory=list)
    words: list[int] = field(default_factory=list)
    blocks: list[int] = field(default_factory=list)
    nodes: list[int] = field(default_factory=list)
    # blocks: their pieces of text, words, and words in links
    texts: list[list[str]] = field(default_factory=lambda: [[]])
    sizes: list[int] = field(default_factory=lambda: [0])
    linked: list[int] = field(default_factory=lambda: [0])


def _hidden(attributes: str) -> bool:
    if "hidden" not in attributes and "none" not in attributes:
        return False
    for key, a, b, c in _ATTRIBUTE.findall(attributes):
        if key.lower() == "aria-hidden" and (a or b or c).strip().lower() == "true" or key.lower() == "hidden":
            return True
    return bool(re.search(r"(?<![\w-])hidden(?=[\s/]|$)", _ATTRIBUTE.sub(" ", attributes)) or re.search(r"display\s*:\s*none", attributes))


def _signs(name: str, attributes: str) -> tuple[list[str], bool]:
    """What an element's name, role, classes and id say, and whether a class or id names boilerplate and nothing else."""
    signs, named = ["e:" + name] if name in DROPPED else ["m:content"] if name in ("article", "main") else [], False
    if not attributes or name in ("html", "body"):
        return signs, named
    for key, a, b, c in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), a or b or c
        if key == "role" and value.strip().lower() in ROLES:
            signs.append("r:" + value.strip().lower())
        elif key in ("class", "id") and name not in ("article", "main"):
            for one in value.split():
                words = [x.lower() for x in _NAME.findall(one)], re.split(r"[_-]+", one.lower())
                hit = any(not NAMES.isdisjoint(w) and all(x in NAMES or x in NEUTRAL for x in w) for w in words)
                named |= hit
                signs.append(("n:" if hit else "c:") + one.lower())
    return signs, named


def parse(html: str) -> Page:
    """The page's tokens, in one pass: every step looks at a bounded number of open elements."""
    page = Page()
    # open elements: name, node, whether in a link, place of the nearest block element and of the nearest other than <p>, at or below
    names, nodes, links, near, solid = ["html"], [0], [False], [0], [0]
    places: dict[str, list[int]] = defaultdict(list)  # name: where it is open
    block = 0

    def cut(depth: int) -> None:
        for name in names[depth:]:
            places[name].pop()
        for stack in (names, nodes, links, near, solid):
            del stack[depth:]

    def new_block() -> None:
        nonlocal block
        if page.texts[block]:
            page.texts.append([])
            page.sizes.append(0)
            page.linked.append(0)
            block += 1

    def token(kind: str, words: int) -> None:
        page.kinds.append(kind)
        page.words.append(words)
        page.blocks.append(block)
        page.nodes.append(nodes[-1])

    def text(raw: str) -> None:
        value = unescape(raw) if "&" in raw else raw
        n = len(value.split())
        if n:
            token(("a:" if links[-1] else "") + names[near[-1]], n)
            page.sizes[block] += n
            page.linked[block] += n * links[-1]
        if n or page.texts[block]:
            page.texts[block].append(value)

    def skip(name: str, at: int) -> int:
        closer = _CLOSERS.setdefault(name, re.compile(rf"</{re.escape(name)}\s*>|\Z", re.I))
        return closer.search(html, at).end()

    at, n = 0, len(html)
    while at < n:
        m = _TOKEN.search(html, at)
        if m is None:
            text(html[at:])
            break
        if m.start() > at:
            text(html[at : m.start()])
        at = m.end()
        name, attributes = (m[2] or "").lower(), m[3] or ""
        if not name:
            continue
        if m[1]:
            if name in BLOCKS:
                new_block()
            depth = places[name][-1] if places[name] else 0
            # an inline element's end does not close blocks that were opened inside it
            if depth and (name in BLOCKS or solid[-1] <= depth):
                cut(depth)
            token("/" + name, 0)
            continue
        if name in BLOCKS:
            k = near[-1]
            while k:
                if name in CLOSED_BY.get(names[k], ()):
                    cut(k)
                    break
                if names[k] != "p":
                    break
                k = near[k - 1]
            new_block()
        elif name in ("br", "img") and page.texts[block]:
            page.texts[block].append(" ")
        token(name, 0)
        if name in VOID or attributes.endswith("/") and name not in BLOCKS:
            continue
        if name in RAW:
            at = skip(name, at)
            continue
        signs, named = _signs(name, attributes)
        if attributes and name not in ("html", "body") and _hidden(attributes):
            signs.append("hidden")
        page.parents.append(nodes[-1])
        page.frames.append(name in ("html", "body"))
        page.signs.append(signs)
        page.marked.append(name in ("article", "main"))
        page.named.append(named)
        depth = len(names)
        places[name].append(depth)
        names.append(name)
        nodes.append(len(page.parents) - 1)
        links.append(links[-1] or name == "a")
        near.append(depth if name in BLOCKS else near[-1])
        solid.append(depth if name in BLOCKS and name != "p" else solid[-1])
    _unwrap(page)
    return page


def _unwrap(page: Page) -> None:
    """Take from wrappers of the content the signs that their classes give."""
    if not any(s[:2] in ("c:", "n:") for own in page.signs for s in own):
        return
    words, holds = [0] * len(page.parents), list(page.marked)
    proper = [False] * len(page.parents)
    for node in range(1, len(words)):
        proper[node] = proper[page.parents[node]] or any(s[:2] in ("e:", "r:") or s == "hidden" for s in page.signs[node])
    for node, n in zip(page.nodes, page.words, strict=True):
        if not proper[node]:
            words[node] += n
    for node in range(len(words) - 1, 0, -1):  # children come after their parents
        words[page.parents[node]] += words[node]
        holds[page.parents[node]] |= holds[node]
    marked = holds[0]
    for node in range(1, len(words)):
        if holds[node] or not marked and 2 * words[node] > words[0]:
            page.signs[node] = [s for s in page.signs[node] if s[:2] not in ("c:", "n:")]
            page.named[node] = False


def _length(n: int) -> str:
    """Bucket of a block's words: 1, 2, 3 to 4, 5 to 8 and so on."""
    return f"l:{min(7, (n - 1).bit_length())}"


def _logit(p: float) -> float:
    return math.log(p / (1 - p))


def _prior(sign: str) -> float | None:
    """Prior chance of content; None for what is judged by the pages alone."""
    if sign[:2] in ("n:", "e:", "r:") or sign == "hidden":
        return UNLIKELY
    return 0.98 if sign == "m:content" else None


class Weights:
    """Log odds of signs, learned from how often words and tags with them lie in the content."""

    def __init__(self, inside: dict[str, float] | None = None, counts: dict[str, float] | None = None, scale: float = 1.0):
        inside, counts = inside or {}, counts or {}
        self.scale = scale
        self.base = (inside.get("", 0.0) + PRIOR * 0.7) / (counts.get("", 0.0) + PRIOR)
        self.odds: dict[str, float] = {}
        for sign in counts:
            if sign:
                self.odds[sign] = self._odds(sign, inside.get(sign, 0.0), counts[sign])

    def _odds(self, sign: str, inside: float, count: float) -> float:
        prior = _prior(sign)
        most = MOST_LOCAL if prior is None else MOST_NAMED
        share = (inside + PRIOR * (self.base if prior is None else prior)) / (count + PRIOR)
        return max(-most, min(most, _logit(min(0.999, max(0.001, share))) - _logit(self.base)))

    def of(self, sign: str) -> float:
        found = self.odds.get(sign)
        if found is None:
            found = self.odds[sign] = self._odds(sign, 0.0, 0.0)
        return found

    def named_odds(self, page: Page) -> list[float]:
        """What the names of each node and of all around it say."""
        out = [0.0] * len(page.parents)
        for node in range(1, len(out)):
            out[node] = out[page.parents[node]] + sum(self.of(s) for s in page.signs[node])
        return out

    def judge(self, page: Page, named: bool = True) -> tuple[list[float], list[float]]:
        """(score, log odds of being content) of each token; ``named``: whether names count."""
        of, base = self.of, _logit(self.base)
        node_odds = self.named_odds(page) if named else [0.0] * len(page.parents)
        block_odds = [of(_length(n)) + of(_linkage(k, n)) if n else 0.0 for n, k in zip(page.sizes, page.linked, strict=True)]
        scores, odds = [], []
        for kind, words, block, node in zip(page.kinds, page.words, page.blocks, page.nodes, strict=True):
            total = base + node_odds[node] + (of("w:" + kind) + block_odds[block] if words else of("t:" + kind))
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, total))))
            odds.append(total)
            scores.append(words * max(0.02, p) if words else -self.scale * (1.1 - p))
        return scores, odds


def _linkage(linked: int, words: int) -> str:
    return "k:none" if not linked else "k:some" if 2 * linked < words else "k:most"


def best_region(scores: list[float]) -> tuple[int, int]:
    """Start and end of the contiguous run with the largest sum; of equals the first; empty if none is positive."""
    best, span, total, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, span = total, (start, i + 1)
    return span


def _element(page: Page, nodes: list[int]) -> tuple[int | None, int]:
    """First and last node of the smallest element that holds all of ``nodes``; None if that is the page itself."""
    ends = list(range(len(page.parents)))
    for node in range(len(ends) - 1, 0, -1):
        up = page.parents[node]
        ends[up] = max(ends[up], ends[node])
    node, last = min(nodes), max(nodes)
    while ends[node] < last:
        node = page.parents[node]
    return (None, 0) if page.frames[node] else (node, ends[node])


def main_text(html: str | None, weights: Weights) -> str:
    if not html:
        return ""
    page = parse(html)
    scores, odds = weights.judge(page)
    a, b = best_region(scores)
    touched = [i for i in range(a, b) if page.words[i]]
    kept = {page.blocks[i] for i in touched if odds[i] >= LEAVE_OUT}
    if not kept:  # nothing here is built like content: only names speak against a block
        named = weights.named_odds(page)
        kept = {page.blocks[i] for i in touched if named[page.nodes[i]] >= LEAVE_OUT}
    else:
        first, last = _element(page, [page.nodes[i] for i in touched if page.blocks[i] in kept])
        if first is not None:
            kept |= {b for b, k, o, n in zip(page.blocks, page.nodes, odds, page.words, strict=True) if n and o >= 0 and first <= k <= last}
    lines = (" ".join("".join(page.texts[k]).split()) for k in sorted(kept))
    return "\n".join(x for x in lines if x)


def _labels(page: Page) -> list[bool]:
    """Per token: inside an <article> or <main>, and in nothing there that is called like boilerplate."""
    inside, out = [False] * len(page.parents), [False] * len(page.parents)
    for node in range(1, len(inside)):
        up = page.parents[node]
        inside[node] = inside[up] or page.marked[node]
        out[node] = out[up] or page.named[node] or any(s[:2] in ("e:", "r:") or s == "hidden" for s in page.signs[node])
    return [inside[k] and not out[k] for k in page.nodes]


def fit(pages: list[str]) -> Weights:
    """Weights from labelled pages: shares of signs, then the tag scale whose regions agree best with the labels."""
    parsed = [(p, _labels(p)) for p in map(parse, pages)]
    parsed = [(p, labels) for p, labels in parsed if any(label and n for label, n in zip(labels, p.words, strict=True))]
    inside: dict[str, float] = defaultdict(float)
    counts: dict[str, float] = defaultdict(float)
    for page, labels in parsed:
        own: dict[str, list[float]] = defaultdict(lambda: [0.0, 0.0])
        within = [[0.0, 0.0] for _ in page.parents]  # words of each node: in the content, and in all
        for kind, n, block, node, label in zip(page.kinds, page.words, page.blocks, page.nodes, labels, strict=True):
            signs = ["w:" + kind, _length(page.sizes[block]), _linkage(page.linked[block], page.sizes[block]), ""] if n else ["t:" + kind]
            for sign in signs:
                own[sign][0] += label * max(1, n)
                own[sign][1] += max(1, n)
            within[node][0] += label * n
            within[node][1] += n
        for node in range(len(within) - 1, 0, -1):
            up = within[page.parents[node]]
            up[0] += within[node][0]
            up[1] += within[node][1]
            for sign in page.signs[node]:
                own[sign][0] += within[node][0]
                own[sign][1] += within[node][1]
        for sign, (a, b) in own.items():  # every page counts once, however long
            if b:
                inside[sign] += a / b
                counts[sign] += 1.0
    best, chosen = -1.0, Weights(inside, counts)
    for scale in TAG_SCALES:
        weights, agreed = Weights(inside, counts, scale), 0.0
        for page, labels in parsed[:SCALE_PAGES]:
            n, y = np.asarray(page.words), np.asarray(labels)
            for named in (True, False):
                scores, odds = weights.judge(page, named)
                a, b = best_region(scores)
                held = np.zeros(len(n), bool)
                held[a:b] = np.asarray(odds[a:b]) >= LEAVE_OUT
                agreed += n[held & y].sum() / max(1, n[held | y].sum())
        if agreed > best + 1e-9:
            best, chosen = agreed, weights
    return chosen


def extract(pages: DataFrame, html_col: str = "html", key_col: str = "page_id"):
    """A pandas UDF from html to main text, its weights fitted on a bounded sample of the labelled pages."""
    small_batches(pages.sparkSession)
    html = F.col(html_col).cast("string")
    marked = pages.where(html.rlike("(?i)<(article|main)[\\s>]")).select(F.coalesce(F.col(key_col).cast("string"), F.lit("")).alias("id"), html.alias("text"))
    sample = fitting_rows(marked, None, FIT_PAGES, FIT_CHARS).sort_values(["id", "text"])
    weights = fit(sample["text"].tolist())

    @F.pandas_udf("string")
    def run(column: pd.Series) -> pd.Series:
        return pd.Series([main_text(h if isinstance(h, str) else None, weights) for h in column], dtype="object")

    return run(html)


def html_extraction(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page: page_id, url, text, n_chars."""
    out = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), extract(pages, html_col, id_col).alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
