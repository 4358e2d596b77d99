"""Operator 10: main-text extraction by minimum-cut labelling.

A page becomes text blocks.  A classifier (logistic, over a block's place in
the page and its text) gives each block a cost for either label; the costs are
the terminal capacities of a flow network whose other edges tie neighbours in
page order and blocks of one container together.  The maximum flow's cut
parts content from boilerplate.  Blocks that their own cost decides whatever
the neighbours do are settled first; the flow runs on the rest.

The classifier is fitted on a bounded sample of pages whose markup names the
article itself (weak labels), starting from and held near PRIOR.

Defined results: null or empty html gives an empty text; a page without
content blocks too; unclosed and stray tags are read as browsers do for
blocks; repeated rows are extracted each on its own; columns of the input that
carry an output name are replaced.
"""

from __future__ import annotations

import html
import math
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, small_batches, texts_of

#: Pages, at most about this many, on which the classifier is fitted.
SAMPLE_PAGES = 2_000
#: Weight of ties between neighbours in page order, and within one container.
NEXT_TO, SAME_CONTAINER = 0.4, 0.6
#: Costs are log odds held within this bound.
MOST_COST = 12.0

# a tag ends at the next tag, too, so an unclosed one is read once
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|<(/?)([A-Za-z][^\s/<>]*+)((?:[^<>"']++|"[^"]*+"|'[^']*+')*+)(?:>|(?=<))""",
                 re.S)
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
# fixed values: elements of HTML by their role
RAW = frozenset("script style noscript template textarea iframe title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt "
    "fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend "
    "li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
BOILERPLATE = frozenset("nav footer aside form button menu dialog fieldset legend label "
                        "head select".split())
CONTENT = frozenset(("article", "main"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BAD_NAMES = frozenset(
    "nav navbar navigation menu header masthead footer sidebar side aside ad ads advert adverts "
    "advertisement advertising banner promo promotion sponsor sponsored sponsors cookie cookies "
    "consent gdpr notice notices notification alert popup modal overlay newsletter subscribe "
    "subscription signup login share sharing social related recommended recommendations "
    "breadcrumb breadcrumbs comment comments commentlist reply replies respond disqus widget "
    "widgets form search pagination pager copyright legal disclaimer toolbar contentinfo "
    "complementary".split())
#: Bad names that say what an article inside is; the others name a layout around it.
PASSED_ON = frozenset(
    "ad ads advert adverts advertisement advertising promo promotion sponsor sponsored sponsors "
    "related recommended recommendations comment comments commentlist reply replies respond "
    "disqus".split())
#: Class names that tell a state of the page, as in has-sidebar.
STATE = re.compile(r"(?:has|with|without|no|is|js)-\S*")
GOOD_NAMES = frozenset("article content post entry story main body text".split())

FEATURES = ("one", "bad_tag", "bad_name", "in_content", "good_name", "words", "links",
            "sentences", "heading", "item", "hidden", "page_header")
PRIOR = np.array([-0.5, -6.0, -6.0, 4.0, 1.0, 0.6, -4.0, 1.0, 0.3, -0.7, -9.0, -4.0])


@dataclass
class Element:
    tag: str
    number: int
    bad_tag: bool
    bad_name: bool
    passed_on: bool
    in_content: bool
    good_name: bool
    hidden: bool
    page_header: bool
    item: bool


@dataclass
class Block:
    text: str
    container: int
    depth: int
    features: list[float]


def element(tag: str, attributes: str, parent: Element | None, number: int) -> Element:
    names: set[str] = set()
    hidden = False
    for m in ATTRIBUTE.finditer(attributes) if attributes.strip() else ():
        key, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
        if key in ("class", "id", "role"):
            names.update(re.split(r"[^a-z0-9]+", STATE.sub(" ", value)))
        hidden |= (key == "hidden" or key == "aria-hidden" and value == "true"
                   or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden",
                                                   value) is not None)
    up = parent
    inside = tag in CONTENT or bool(up and up.in_content)
    whole = tag in ("html", "body")  # a page-wide name says nothing about its parts
    passed_on = not whole and bool(names & PASSED_ON) or bool(up and up.passed_on)
    around = bool(up and up.bad_name) and tag not in CONTENT
    return Element(
        tag, number, tag in BOILERPLATE or bool(up and up.bad_tag),
        not whole and bool(names & BAD_NAMES) or around or passed_on, passed_on, inside,
        not whole and bool(names & GOOD_NAMES) or bool(up and up.good_name),
        hidden or bool(up and up.hidden),
        tag == "header" and not inside or bool(up and up.page_header),
        tag in ("li", "dt", "dd", "td", "th") or bool(up and up.item))


def blocks(page: str) -> list[Block]:
    """The page's text blocks in order, with their classifier features."""
    out: list[Block] = []
    stack: list[Element] = []
    text: list[str] = []
    linked = link_depth = number = 0

    def flush() -> None:
        nonlocal linked
        joined = " ".join(html.unescape("".join(text)).split())
        if joined:
            e = stack[-1] if stack else element("body", "", None, 0)
            words = joined.count(" ") + 1
            ends = len(re.findall(r"[.!?…](?=\s|$)", joined))
            out.append(Block(joined, stack[-2].number if len(stack) > 1 else 0, len(stack), [
                1.0, float(e.bad_tag), float(e.bad_name), float(e.in_content), float(e.good_name),
                round(math.log1p(min(words, 200)), 1),
                round(4 * min(1.0, linked / len(joined))) / 4, float(ends > 0),
                float(any(x.tag in HEADINGS for x in stack)), float(e.item), float(e.hidden),
                float(e.page_header)]))
        text.clear()
        linked = 0

    at, n = 0, len(page)
    while at < n:
        m = TAG.search(page, at)
        piece = page[at:m.start() if m else n]
        if piece:
            text.append(piece)
            if link_depth:
                linked += len(piece.strip())
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:  # an end tag
            if tag == "a":
                link_depth = max(0, link_depth - 1)
            if tag in BLOCKS:
                flush()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
            continue
        if tag in RAW and not m[3].endswith("/"):
            end = re.compile(f"</{tag}[^>]*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if tag == "a":
            link_depth += 1
        if tag in BLOCKS:
            flush()
            link_depth = 0 if tag != "br" else link_depth
        if tag in VOID or m[3].endswith("/"):
            continue
        if tag in BLOCKS:
            # what a new block closes by itself: an open paragraph, or its own kind in a list
            close = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"),
                     "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
                     "body": ("head",)}.get(tag, ()) + ("p",)
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].tag in close:
                    del stack[i:]
                    break
                if stack[i].tag in BLOCKS:
                    break
        if tag in BLOCKS or tag in BOILERPLATE or "class" in m[3] or "hidden" in m[3] \
                or "style" in m[3] or "id=" in m[3] or "role" in m[3]:
            number += 1
            stack.append(element(tag, m[3], stack[-1] if stack else None, number))
    flush()
    return out


def cut(costs: list[float], ties: list[tuple[int, int, float]]) -> list[bool]:
    """Minimum cut: True for the nodes on the content side.  ``costs``: positive
    is what calling the node boilerplate costs, negative what content costs."""
    n = len(costs)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, w in ties:
        near[a][b] = near[a].get(b, 0.0) + w
        near[b][a] = near[b].get(a, 0.0) + w
    own, label = list(costs), [None] * n
    todo = deque(range(n))
    while todo:  # a node whose cost outweighs all its open ties is settled
        i = todo.popleft()
        if label[i] is None and abs(own[i]) >= sum(near[i].values()):
            label[i] = own[i] > 0
            for j, w in near[i].items():
                own[j] += w if label[i] else -w
                del near[j][i]
                todo.append(j)
            near[i] = {}
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        source, sink = n, n + 1
        room: dict[int, dict[int, float]] = {i: dict(near[i]) for i in rest}
        room[source] = {i: own[i] for i in rest if own[i] > 0}
        room[sink] = {}
        for i in rest:
            room[i][source] = 0.0
            room[i][sink] = max(0.0, -own[i])
            room[sink][i] = 0.0

        def reach() -> dict[int, int]:
            came, line = {source: source}, deque([source])
            while line:
                i = line.popleft()
                for j, c in room[i].items():
                    if c > 1e-12 and j not in came:
                        came[j] = i
                        line.append(j)
            return came

        came = reach()
        while sink in came:
            path, j = [], sink
            while j != source:
                path.append((came[j], j))
                j = came[j]
            flow = min(room[i][j] for i, j in path)
            for i, j in path:
                room[i][j] -= flow
                room[j][i] = room[j].get(i, 0.0) + flow
            came = reach()
        for i in rest:
            label[i] = i in came
    return [bool(x) for x in label]


def ties_of(found: list[Block]) -> list[tuple[int, int, float]]:
    """Edges to the next block, and to the next one of the same container."""
    out, last = [], {}
    for i, b in enumerate(found):
        if i:
            far = abs(b.depth - found[i - 1].depth) + (b.container != found[i - 1].container)
            out.append((i - 1, i, NEXT_TO / (1 + far)))
        if b.container in last:
            out.append((last[b.container], i, SAME_CONTAINER))
        last[b.container] = i
    return out


def main_text(page: str, weights: np.ndarray) -> str:
    found = blocks(page)
    if not found:
        return ""
    costs = np.clip(np.array([b.features for b in found]) @ weights, -MOST_COST, MOST_COST)
    keep = cut(costs.tolist(), ties_of(found))
    return " ".join(b.text for b, k in zip(found, keep) if k)


#: Features that the fit learns; those of the markup, which the weak label is made of, keep
#: their prior weight.
LEARNED = [FEATURES.index(f) for f in ("one", "words", "links", "sentences", "heading", "item")]


def weak_label(f: list[float]) -> float:
    """Content by the markup alone: in an article, and in nothing that isn't."""
    v = dict(zip(FEATURES, f))
    return float(v["in_content"] and not (v["bad_tag"] or v["bad_name"] or v["hidden"]))


def fit(pages: DataFrame, sample_pages: int = SAMPLE_PAGES, hold: float = 2.0) -> np.ndarray:
    """Weights from a sample of pages that name their article; equal feature rows
    are counted by Spark first.  The text's features alone are fitted to what the
    markup says, so they can tell content on pages without such markup.
    ``hold`` ties the weights to PRIOR."""
    small_batches(pages.sparkSession)
    n = pages.count()
    share = min(1.0, sample_pages / max(n, 1))
    some = pages.select("html").where(
        F.pmod(F.xxhash64("html"), F.lit(1 << 20)) < int(share * (1 << 20)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for page in texts_of(b.column(0)):
                found = [x.features for x in blocks(page)]
                if any(f[FEATURES.index("in_content")] for f in found):
                    rows += [[*f, weak_label(f)] for f in found]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64()))], names=["f"])

    got = some.mapInArrow(run, "f array<double>").groupBy("f").agg(
        F.count(F.lit(1)).alias("n")).collect()
    w = PRIOR.copy()
    if not got:
        return w
    x = np.array([r["f"] for r in got])
    x, y, c = x[:, LEARNED], x[:, -1], np.array([r["n"] for r in got], float)
    c *= 1000 / c.sum()
    v, prior = PRIOR[LEARNED].copy(), PRIOR[LEARNED]
    for _ in range(25):  # Newton steps of logistic regression held near the prior
        p = 1 / (1 + np.exp(-np.clip(x @ v, -30, 30)))
        grad = x.T @ (c * (p - y)) + hold * (v - prior)
        hess = (x * (c * p * (1 - p))[:, None]).T @ x + hold * np.eye(len(v))
        v = v - np.linalg.solve(hess, grad)
    w[LEARNED] = v
    return w


FIELDS = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])


def extracted(pages: DataFrame, sample_pages: int = SAMPLE_PAGES) -> DataFrame:
    """``pages`` without html, with text and n_chars."""
    weights = fit(pages, sample_pages)

    def fn(arr: pa.Array) -> list[pa.Array]:
        found = [main_text(p, weights) for p in texts_of(arr)]
        return [pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())]

    return append_columns(pages, "html", fn, FIELDS, drop=("html",))
