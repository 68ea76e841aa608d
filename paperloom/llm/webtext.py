"""Main text of web pages as the maximum-scoring subsequence of their tokens.

A page is read as a sequence of words and tags. Weights are fitted on labelled pages: those that have
content elements (article, main) say what stands inside and outside of them. A feature is a tag or a
class, id or role value, apart for inside and outside of content elements; its weight is the log odds
of an element with it holding content, where the outermost element without content answers for all
that is in it. An element whose weights add up to less than CUT is no content: its words score nothing
and are left out. Other words score positive, or negative where words at that place are not content on
labelled pages; tags score negative by their weights. One linear scan finds the contiguous run of the
highest total, and its blocks are the text. On tables without labelled pages the weights are the prior
alone: few pseudo-counts for the elements and names of page furniture, which labelled pages outvote.
Tags within content elements, and tags without content of their own, cost nothing, so that tables,
figures and breaks part no article. A page may have several articles: other maximal runs are kept as
well where they hold words of a content element.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pages the weights are fitted on (about as many, chosen by hash), and the weights kept (the most frequent).
LABELLED_PAGES, MOST_WEIGHTS = 1_000, 20_000
#: An element whose weights add up to less is left out.
CUT = -1.0
#: Pseudo-counts (inside, outside) of a feature, and of one that names page furniture.
PRIOR, FURNITURE = (1.0, 1.0), (0.5, 4.0)
WORD, LINK_WORD, LEAST_TAG, MOST_TAG, BORDER = 1.0, 0.1, -3.0, -0.05, -0.5
#: Scores of the tags of links and lists that no labelled page has.
LIST_TAGS = {"a": -2.0, "li": -1.0, "option": -2.0}
#: Elements and names of page furniture (the prior), blocks, and elements without an end tag.
NEVER = {"script", "style", "noscript", "template", "head", "nav", "header", "footer", "aside", "form", "button", "select", "textarea", "iframe", "svg", "canvas", "object", "dialog", "menu"}
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe"}
NEVER_WORDS = {"ad", "ads", "advert", "adverts", "advertisement", "sponsor", "sponsored", "promo", "banner", "nav", "navbar", "menu", "breadcrumb", "breadcrumbs", "sidebar", "footer", "header", "comment", "comments", "disqus", "cookie", "cookies", "consent", "notice", "popup", "modal", "newsletter", "subscribe", "share", "social", "related", "widget", "toolbar", "pagination"}
#: Words that may stand with those in a compound (top-banner, sidebar__inner); with others (has-sidebar, entry-header) a mark says nothing.
BESIDE = {"top", "bottom", "left", "right", "site", "global", "primary", "secondary", "area", "bar", "block", "box", "buttons", "container", "inner", "item", "items", "links", "list", "outer", "section", "slot", "unit", "wrap", "wrapper"}
#: The frame of a page, whose class values say nothing about its content; elements that don't end an open head.
FRAME = {"html", "body", "article", "main"}
IN_HEAD = {"base", "basefont", "bgsound", "head", "html", "link", "meta", "noframes", "noscript", "script", "style", "template", "title"}
CONTENT = {"article", "main"}
BLOCKS = {"address", "article", "blockquote", "body", "caption", "center", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption", "figure", "h1", "h2", "h3", "h4", "h5", "h6", "hr", "html", "legend", "li", "main", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", *NEVER} - {"button", "select", "svg", "canvas", "object"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
CLOSED_BY_NEXT = {"p": {"p", "div", "ul", "ol", "table", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "blockquote", "footer", "header", "nav", "aside", "form", "main", "pre", "figure", "hr"}, "li": {"li"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)", re.DOTALL)
MARKS = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
DIGITS = re.compile(r"[0-9]+")
SPLIT = re.compile(r"[^a-z0-9]+")
SPACE = re.compile(r"\s+")


def values_of(attributes: str) -> list[str]:
    """The classes, id and role of an element, each whole."""
    return [v for m in MARKS.finditer(attributes) for v in (m[2] or m[3] or m[4] or "").lower().split()] if attributes else []


def tokens(page: str) -> Iterator[tuple[str, str, list[str]]]:
    """("text", text, []), ("open", tag, values) and ("close", tag, []) in page order; raw elements have no text."""
    at, n = 0, len(page)
    while at < n:
        m = TOKEN.search(page, at)
        if not m:
            yield "text", page[at:], []
            return
        if m.start() > at:
            yield "text", page[at : m.start()], []
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            yield "close", tag, []
            continue
        yield "open", tag, values_of(m[3])
        if tag in RAW and not m[3].endswith("/"):
            end = re.compile(rf"</{tag}\s*>", re.IGNORECASE).search(page, at)
            at = end.end() if end else n
            yield "close", tag, []


@dataclass(slots=True)
class Element:
    tag: str
    values: list[str]
    parent: int
    #: Whether a content element is around it.
    within: bool


def pieces(page: str) -> tuple[list[Element], list[tuple[str, str, int]]]:
    """The elements in page order, a root without tag first, and (kind, value, element).

    kind is "open", "close" (value: the tag), "text", or "break" between blocks. Open elements are
    found by name, so that pages with very many unclosed tags are read in linear time.
    """
    elements, out = [Element("", [], -1, False)], []
    stack: list[int] = [0]
    blocks, walls = [0], [0]  # per open element: depth of the block, and of the content element or furniture, around it
    depth_of: dict[str, list[int]] = {}

    def cut(depth: int) -> None:
        for e in stack[depth:]:
            depth_of[elements[e].tag].pop()
        del stack[depth:], blocks[depth:], walls[depth:]

    def opened(tag: str) -> int:
        held = depth_of.get(tag)
        return held[-1] if held else 0

    for kind, value, values in tokens(page):
        if kind == "text":
            if elements[stack[-1]].tag == "head" and value.strip():
                cut(opened("head"))
            out.append(("text", value, stack[-1]))
        elif kind == "open":
            if value not in IN_HEAD and opened("head"):
                cut(opened("head"))
            while value in CLOSED_BY_NEXT.get(elements[stack[-1]].tag, ()):
                cut(len(stack) - 1)
            # an unclosed inline element ends with its paragraph
            if value in CLOSED_BY_NEXT["p"] and elements[stack[blocks[-1]]].tag == "p":
                cut(blocks[-1])
            around = elements[stack[-1]]
            elements.append(Element(value, values, stack[-1], around.within or around.tag in CONTENT))
            if value in BLOCKS:
                out.append(("break", "", len(elements) - 1))
            out.append(("open", value, len(elements) - 1))
            if value not in VOID:
                depth = len(stack)
                stack.append(len(elements) - 1)
                blocks.append(depth if value in BLOCKS else blocks[-1])
                walls.append(depth if value in CONTENT or value in NEVER else walls[-1])
                depth_of.setdefault(value, []).append(depth)
        else:
            out.append(("close", value, stack[-1]))
            depth = opened(value)
            if depth and (value in BLOCKS or depth >= walls[-1]):
                cut(depth)
            if value in BLOCKS:
                out.append(("break", "", stack[-1]))
    return elements, out


def noted(value: str) -> bool:
    """Whether a class, id or role as a whole names page furniture."""
    ws = {w for w in SPLIT.split(value) if w and not w.isdigit()}
    return bool(ws & NEVER_WORDS) and ws <= NEVER_WORDS | BESIDE


def features(e: Element) -> list[str]:
    """Its class values (digits as 0), each marked by a point, and last its tag; "in " before what stands within content."""
    place = "in " if e.within else ""
    return [*([] if e.tag in FRAME else [f"{place}.{DIGITS.sub('0', v)}" for v in e.values]), place + e.tag]


def prior(feature: str) -> tuple[float, float]:
    name = feature.removeprefix("in ")
    if name[:1] == ".":
        return FURNITURE if noted(name[1:]) else PRIOR
    # a header within content is its heading, not the page's
    return FURNITURE if name in NEVER and feature != "in header" else PRIOR


def odds(feature: str, inside: float = 0.0, outside: float = 0.0) -> float:
    a, b = prior(feature)
    return log((inside + a) / (outside + b))


def weight(weights: dict[str, float], feature: str) -> float:
    return weights[feature] if feature in weights else odds(feature)


def label_counts(page: str) -> Counter:
    """(feature, content) -> how often, for elements that hold content and the outermost of those that don't.

    Features "text ..." count words by the tag that they directly stand in. Labels are the content
    elements without furniture; a page that has none counts for nothing.
    """
    elements, found = pieces(page)
    gone = [False] * len(elements)
    for k, e in enumerate(elements[1:], 1):
        gone[k] = gone[e.parent] or sum(odds(f) for f in features(e)) < CUT
    words, content = [0] * len(elements), [0] * len(elements)
    for kind, value, k in found:
        if kind == "text":
            n = len(value.split())
            words[k] += n
            content[k] += n if not gone[k] and (elements[k].within or elements[k].tag in CONTENT) else 0
    direct = list(zip(words, content, strict=True))
    for k in range(len(elements) - 1, 0, -1):
        words[elements[k].parent] += words[k]
        content[elements[k].parent] += content[k]
    out: Counter = Counter()
    if not content[0]:
        return out
    mixed = [True] * len(elements)
    for k, e in enumerate(elements[1:], 1):
        mixed[k] = content[k] > 0
        if words[k] and (content[k] or mixed[e.parent]):
            # an element with class values is told by them, one without by its tag
            keys = features(e)
            out.update((f, content[k] > 0) for f in (keys[:-1] or keys))
    for k, (n, inside) in enumerate(direct):
        if n and mixed[k]:
            out["text " + features(elements[k])[-1], True] += inside
            out["text " + features(elements[k])[-1], False] += n - inside
    return out


def fit_weights(counts: Counter) -> dict[str, float]:
    """Weights of features from counts by (feature, content)."""
    return {f: odds(f, counts[f, True], counts[f, False]) for f in {f for f, _ in counts}}


def best_run(scores: list[float]) -> tuple[int, int]:
    """The contiguous run of the highest total, the longest of equals that begin alike; empty if all are negative."""
    best, first, last, total, start = 0.0, 0, 0, 0.0, 0
    for k, x in enumerate(scores):
        if total <= 0:
            total, start = 0.0, k
        total += x
        if total > best:
            best, first, last = total, start, k + 1
    return first, last


def maximal_runs(scores: list[float]) -> list[tuple[int, int]]:
    """All maximal runs in order: the best one, and in turn those to its left and right.

    One pass. A run in the making is kept with the totals before its start and up to its end, and
    with the last run before it whose start lies lower; a new one swallows all that it can raise.
    """
    runs: list[tuple[int, int, float, float, int]] = []
    total = 0.0
    for k, x in enumerate(scores):
        before, total = total, total + x
        if x <= 0:
            continue
        first, low, high = k, before, total
        at = len(runs) - 1
        while True:
            while at >= 0 and runs[at][2] >= low:
                at = runs[at][4]
            if at < 0 or runs[at][3] >= high:
                break
            first, low, at = runs[at][0], runs[at][2], at - 1
            del runs[at + 1 :]
        runs.append((first, k + 1, low, high, at))
    return [(a, b) for a, b, *_ in runs]


def scored(page: str, weights: dict[str, float]) -> tuple[list[tuple[str, str, bool, bool]], list[float]]:
    """(kind, value, left out, whether words of a content element) in page order, and their scores."""
    elements, found = pieces(page)
    gone, own = [False] * len(elements), [0.0] * len(elements)
    link = [e.tag == "a" and not e.within for e in elements]
    for k, e in enumerate(elements[1:], 1):
        own[k] = sum(weight(weights, f) for f in features(e))
        gone[k] = gone[e.parent] or own[k] < CUT
        link[k] |= link[e.parent]
    tokens, scores = [], []
    for kind, value, k in found:
        e = elements[k]
        content = e.within or e.tag in CONTENT
        tokens.append((kind, value, gone[k], content and kind == "text" and not gone[k] and not value.isspace()))
        if kind == "text":
            place = weights.get("text " + features(e)[-1], 0.0)
            worth = -WORD if place < CUT else LINK_WORD if link[k] else WORD
            scores.append(0.0 if gone[k] else worth * len(value.split()))
        elif kind == "open" and e.tag in CONTENT and not e.within and not gone[k]:
            scores.append(BORDER)  # a stray link before it isn't drawn in
        elif kind == "open" and not gone[e.parent] and not content and value not in VOID:
            # what is left out costs little: text goes on after it
            unseen = LIST_TAGS.get(value, MOST_TAG) if not e.within and features(e)[-1] not in weights else MOST_TAG
            scores.append(MOST_TAG * 10 if gone[k] else max(LEAST_TAG, min(unseen, own[k])))
        else:
            scores.append(0.0)
    return tokens, scores


def main_text(page: str | None, weights: dict[str, float]) -> str:
    tokens, scores = scored(page or "", weights)
    best = best_run(scores)
    others = [(a, b) for a, b in maximal_runs(scores) if (b <= best[0] or a >= best[1]) and any(t[3] for t in tokens[a:b])]
    blocks, now = [], []
    for first, last in sorted([best, *others]):
        for kind, value, gone, _ in tokens[first:last]:
            if kind == "break":
                blocks.append("".join(now))
                now = []
            elif kind == "text" and not gone:
                now.append(html.unescape(value))
            elif kind == "open" and value == "br":
                now.append(" ")
        blocks.append("".join(now))
        now = []
    cleaned = (SPACE.sub(" ", b).strip() for b in blocks)
    return "\n\n".join(b for b in cleaned if b)


def fit(pages: DataFrame, rows: int = LABELLED_PAGES) -> dict[str, float]:
    """Weights from about ``rows`` pages, chosen by hash where they stand; only counts leave the tasks."""
    share = max(1, pages.count() // rows)
    some = pages.where(F.pmod(F.xxhash64("page_id", "url"), F.lit(share)) == 0) if share > 1 else pages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total: Counter = Counter()
            for page in batch.column(0).to_pylist():
                total.update(label_counts(page or ""))
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in total], pa.string()), pa.array([x for _, x in total], pa.bool_()), pa.array(list(total.values()), pa.int64())], names=["feature", "inside", "n"])

    counted = some.select("html").mapInArrow(run, "feature string, inside boolean, n bigint").groupBy("feature").agg(F.sum(F.when(F.col("inside"), F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(~F.col("inside"), F.col("n")).otherwise(0)).alias("b"))
    made = counted.orderBy((F.col("a") + F.col("b")).desc(), "feature").limit(MOST_WEIGHTS).collect()
    return {r.feature: odds(r.feature, r.a, r.b) for r in made}


def extract(pages: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Per page: page_id, url, text, n_chars. A null or empty page, or one without content, has an empty text.

    Whole pages are read, however long, in time linear in their length. Repeated rows stay, an empty
    table stays empty, other columns are not looked at.
    """
    held = pages.sparkSession.sparkContext.broadcast(fit(pages) if weights is None else weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x, held.value) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html").mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
