"""Main-text extraction by a minimum cut.

A page becomes blocks of text and the elements that hold them.  A classifier's costs for
calling a block content or boilerplate are the capacities of its edges to the two
terminals; blocks that follow each other, and blocks and elements next to each other in
the DOM, are joined by smoothness edges.  The minimum cut, by maximum flow, is the
labelling of least cost.

The classifier is a logistic regression over a block's shape (length, links, punctuation,
tag), fitted with numpy on up to TRAIN_PAGES pages whose own markup tells content from
boilerplate; what the markup says of a block is then added to its score.  Elements that
exist to hold content or boilerplate say more than names of classes do, which the
classifier and the neighbours can outvote.
"""

from __future__ import annotations

import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

TRAIN_PAGES = 2000
#: Smoothness between blocks in a row and between an element and what it holds.
NEXT, DOM = 0.6, 0.4
#: That between a heading and the block after it, if one element holds both: a heading goes with what it heads.
HEADED = 8.0
#: Most that the classifier gives a block; what an element's kind adds to it, and what a class name does.
SHAPE, MARKED, NAMED = 4.0, 6.0, 3.0

# Element names and words of class, id and role.
SKIPPED = frozenset("head script style noscript template iframe svg canvas object embed audio video select option textarea button annotation annotation-xml".split())
RAW = frozenset("script style textarea title iframe noscript xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rb rp rt rtc s samp small span strike strong sub sup time tt u var wbr img br".split())
#: Formulas are text: their elements hold parts of a line.
MATH = frozenset("math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom menclose msub msup msubsup munder mover munderover mmultiscripts mprescripts mtable mtr mtd maction semantics".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
BOILERPLATE = frozenset("nav footer aside form menu dialog fieldset".split())
CONTENT = frozenset("article main".split())
NEGATIVE = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adv|advert\w*|adsense|banner|sponsor\w*|promo\w*|side|sidebar|menu|nav|navbar|navigation|breadcrumb\w*|footer|foot|header|masthead|cookie\w*"
    r"|consent|gdpr|notice|notification|alert|popup|modal|overlay|share|sharing|social|related|recommend\w*|newsletter|subscri\w*|signup|login|search|form|widget\w*|toolbar"
    r"|pagination|pager|copyright|legal|disclaimer|contentinfo|complementary|dialog|discussion|reviews?)(?:$|[\s_-])",
    re.I,
)
REMARKS = re.compile(r"(?:^|[\s_-])(?:comments?|commentlist|replies|reply|respond|disqus)(?:$|[\s_-])", re.I)
POSITIVE = re.compile(r"(?:^|[\s_-])(?:article|main|content|post|story|entry|maintext|articlebody)(?:$|[\s_-])", re.I)

_TOKEN = re.compile(
    r"<!--(?:.*?-->|.*\Z)|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?>[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?][^>]*>|(?P<text>[^<]+|<)", re.S
)
#: An attribute's value, and the attribute hidden once values are gone.
_VALUE = re.compile(r"=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'>]+)")
_HIDDEN = re.compile(r"(?:^|[\s/])hidden(?=[\s=/]|$)", re.I)
_ATTR = re.compile(r"([a-zA-Z:-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")


@dataclass
class Block:
    text: str
    element: int  # the element that holds it
    tag: str
    links: int  # characters in links
    mark: int  # -1 boilerplate, 1 content, 0 not told; below -1: readers' comments, or hidden
    named: bool = False  # told by the name of a class only


def parse(html: str) -> tuple[list[Block], list[int]]:
    """Blocks in page order, and each element's parent (element 0 is the page)."""
    parents, tags, marks, named = [-1], ["#page"], [0], [False]
    stack, outer = [0], [0]  # open elements; of each, the nearest that is not inline
    opened: Counter[str] = Counter()  # open elements by name
    blocks: list[Block] = []
    parts: list[str] = []
    linked = [0, 0]  # characters in links, open links
    owner = 0
    endless: set[str] = set()  # elements without an end tag from here on

    def flush():
        nonlocal parts
        text = " ".join(unescape("".join(parts)).split()) if parts else ""
        if text:
            blocks.append(Block(text, owner, tags[owner], min(linked[0], len(text)), marks[owner], named[owner]))
        parts, linked[0] = [], 0

    def close() -> None:
        element = stack.pop()
        outer.pop()
        opened[tags[element]] -= 1
        if tags[element] == "a":
            linked[1] -= 1

    at, end = 0, len(html)
    while at < end:
        m = _TOKEN.match(html, at)
        if m is None:  # a tag that never ends
            break
        at = m.end()
        if m["text"] is not None:
            now = outer[-1]
            if now != owner:
                flush()
                owner = now
            parts.append(m["text"])
            if linked[1]:
                linked[0] += len(m["text"])
            continue
        if m["name"] is None:
            continue
        name = m["name"].lower()
        if name in MATH:
            continue
        if m["close"]:
            if name == "br" or not opened[name]:
                continue
            if name not in INLINE:
                flush()
            while tags[stack[-1]] != name:
                close()
            close()
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name in VOID:
            if name == "hr":
                flush()
            continue
        if name in RAW or name in SKIPPED:
            # skip all it holds; an end tag that was not found is not looked for again
            ends = None if name in endless else re.compile(rf"</{re.escape(name)}\s*>", re.I).search(html, at)
            if ends is None:
                endless.add(name)
            if name in RAW or name in ("svg", "select", "button", "object", "canvas", "audio", "video"):
                at = ends.end() if ends else (end if name in RAW else at)
                continue
            if name == "head":
                body = re.compile(r"</head\s*>|<body[\s>]", re.I).search(html, at) if "body" not in endless else None
                if body is None:
                    endless.add("body")
                at = body.start() if body else at
                continue
            at = ends.end() if ends else at
            continue
        if name not in INLINE:
            flush()
            for _ in range(_implied(name, stack, tags, opened)):
                close()
        attrs = {k.lower(): a or b or c for k, a, b, c in _ATTR.findall(m["attrs"])} if m["attrs"].strip() else {}
        parent = stack[-1]
        element = len(parents)
        parents.append(parent)
        tags.append(name)
        own, by_name = _mark(name, attrs, m["attrs"], marks[parent], named[parent])
        marks.append(own)
        named.append(by_name)
        if name == "a":
            linked[1] += 1
        stack.append(element)
        outer.append(outer[-1] if name in INLINE else element)
        opened[name] += 1
        if name not in INLINE:
            owner = element
    flush()
    return blocks, parents


def _implied(name: str, stack: list[int], tags: list[str], opened: Counter) -> int:
    """How many open elements a new one ends: a block ends an open paragraph; list items, cells and rows end their like."""
    like = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}.get(name, set())
    holds = {"ul", "ol", "dl", "table", "tbody", "thead", "#page", "body", "div", "article", "section"}
    if not opened["p"] and not any(opened[x] for x in like):
        return 0
    ends = 0
    for depth, element in enumerate(reversed(stack), 1):
        tag = tags[element]
        if tag in holds:
            break
        if tag == "p" or tag in like:
            ends = depth
            if tag in like or not like:
                break
    return ends


def _mark(name: str, attrs: dict, raw: str, above: int, above_named: bool) -> tuple[int, bool]:
    """What the markup says, and whether a name only says it; -2 marks reader comments and -3 what is hidden, which nothing inside undoes."""
    if above in (-2, -3):
        return above, False
    said = " ".join(attrs.get(k, "") for k in ("class", "id", "role"))
    if REMARKS.search(said) and name != "body":
        return -2, False
    if attrs.get("aria-hidden") == "true" or ("hidden" in raw.lower() and _HIDDEN.search(_VALUE.sub("= ", raw))) or "display:none" in attrs.get("style", "").replace(" ", "").lower():
        return -3, False
    if name in CONTENT or attrs.get("role") in CONTENT:
        return 1, False
    if name in BOILERPLATE or (name == "header" and above != 1):
        return -1, False
    if name != "body" and said.strip():
        if NEGATIVE.search(said):
            return -1, above_named or above != -1
        if POSITIVE.search(said):
            return 1, above_named or above != 1
    return above, above_named


FEATURES = 9


def shape(b: Block) -> list[float]:
    n = len(b.text)
    words = b.text.count(" ") + 1
    marks = sum(map(b.text.count, ".,;:!?"))
    return [
        1.0, min(np.log1p(words), 6.0), b.links / n, min(marks / words, 1.0), float(b.tag == "p"), float(b.tag in ("li", "td", "th", "dd", "dt")),
        float(b.tag in ("h1", "h2", "h3", "h4", "h5", "h6")), float(b.text[-1] in ".!?\"'"), float(words < 4),
    ]


def fit(rows: np.ndarray, labels: np.ndarray, rounds=200, rate=0.5) -> np.ndarray:
    """Logistic regression with both classes weighing alike; zeros if one is missing."""
    w = np.zeros(FEATURES)
    if not len(labels) or labels.min() == labels.max():
        return w
    weight = np.where(labels == 1, 0.5 / (labels == 1).sum(), 0.5 / (labels == 0).sum())
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(rows @ w, -30, 30)))
        w -= rate * (rows.T @ (weight * (p - labels)) + 1e-3 * w)
    return w


def train(pages: DataFrame, *, id_column="page_id", html_column="html", most: int = TRAIN_PAGES) -> np.ndarray:
    """Weights from up to most pages, by hash of the id, that mark content and boilerplate themselves. At most FEATURES sums a page reach the driver.

    Pages are chosen by id and place; only the chosen ones' html is then read.
    """
    pages = common.located(pages)
    order = F.xxhash64(F.col(id_column))
    chosen = pages.where(F.col(html_column).isNotNull()).select("__file", "__row", order.alias("h")).orderBy("h", "__file", "__row").limit(most)
    chosen = common.small(chosen.select("__file", "__row"), most, 48)
    chosen = pages.select("__file", "__row", F.col(html_column).alias("html")).join(chosen, ["__file", "__row"]).select("html")

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for html in pdf["html"]:
                told = [b for b in parse(html)[0] if b.mark]
                for sign in (1, -1):
                    own = [shape(b) for b in told if (b.mark > 0) == (sign > 0)]
                    if own:  # the page's mean content block and mean boilerplate block
                        out.append((int(sign > 0), np.mean(own, axis=0).tolist()))
            yield pd.DataFrame(out, columns=["y", "x"])

    rows = chosen.mapInPandas(look, "y int, x array<double>").collect()
    rows.sort(key=lambda r: (r["y"], r["x"]))
    return fit(np.array([r["x"] for r in rows]).reshape(-1, FEATURES), np.array([r["y"] for r in rows]))


class Flow:
    """Maximum flow by shortest augmenting levels (Dinic), with the source side of the least cut."""

    def __init__(self, n: int):
        self.n, self.edges, self.cap, self.to = n, [[] for _ in range(n)], [], []

    def add(self, a: int, b: int, there: float, back: float = 0.0) -> None:
        for x, y, c in ((a, b, there), (b, a, back)):
            self.edges[x].append(len(self.to))
            self.to.append(y)
            self.cap.append(c)

    def _levels(self, s: int) -> list[int]:
        level = [-1] * self.n
        level[s] = 0
        queue = deque([s])
        while queue:
            x = queue.popleft()
            for e in self.edges[x]:
                y = self.to[e]
                if self.cap[e] > 1e-9 and level[y] < 0:
                    level[y] = level[x] + 1
                    queue.append(y)
        return level

    def cut(self, s: int, t: int) -> list[bool]:
        """Which nodes are on the source's side when flow is greatest."""
        to, cap = self.to, self.cap
        while (level := self._levels(s))[t] >= 0:
            nxt = [0] * self.n
            path: list[int] = []
            x = s
            while True:
                if x == t:
                    f = min(cap[e] for e in path)
                    for e in path:
                        cap[e] -= f
                        cap[e ^ 1] += f
                    first = next(i for i, e in enumerate(path) if cap[e] <= 1e-9)
                    x = to[path[first] ^ 1]
                    del path[first:]
                    continue
                while nxt[x] < len(self.edges[x]):
                    e = self.edges[x][nxt[x]]
                    if cap[e] > 1e-9 and level[to[e]] == level[x] + 1:
                        break
                    nxt[x] += 1
                else:
                    if x == s:
                        break
                    level[x] = -1
                    x = to[path.pop() ^ 1]
                    continue
                path.append(e)
                x = to[e]
        return [v >= 0 for v in self._levels(s)]


def label(blocks: list[Block], parents: list[int], weights: np.ndarray) -> list[bool]:
    """Which blocks are content."""
    if not blocks:
        return []
    told = any(b.mark > 0 for b in blocks)
    x = np.array([shape(b) for b in blocks])
    mark = np.sign([b.mark for b in blocks])
    # readers' comments are written like an article: no shape or neighbour makes them one
    said = np.array([2 * (SHAPE + MARKED) if b.mark < -1 else NAMED if b.named else MARKED for b in blocks])
    z = np.clip(x @ weights, -SHAPE, SHAPE) + said * mark
    if told:  # the page marks its content: what lies outside is likely none
        z = z - np.where(mark == 0, NAMED, 0.0)
    # a heading is what it heads: its own score must not drag the other out
    heads = {i for i, (a, b) in enumerate(zip(blocks, blocks[1:], strict=False)) if a.tag in HEADINGS and b.tag not in HEADINGS and a.mark == b.mark and parents[a.element] in (parents[b.element], b.element)}
    at = sorted(heads)
    z[at] = np.clip(z[at], -1, 1)
    n = len(blocks)
    # nodes: blocks, then the elements that hold any, then the terminals
    held: dict[int, int] = {}
    for b in blocks:
        e = b.element
        while e >= 0 and e not in held:
            held[e] = n + len(held)
            e = parents[e]
    s, t = n + len(held), n + len(held) + 1
    flow = Flow(t + 1)
    for i, score in enumerate(z.tolist()):
        flow.add(s, i, float(np.logaddexp(0, score)))  # cost of calling it boilerplate
        flow.add(i, t, float(np.logaddexp(0, -score)))  # cost of calling it content
        flow.add(i, held[blocks[i].element], DOM, DOM)
        if i:
            near = HEADED if i - 1 in heads else NEXT if blocks[i].mark == blocks[i - 1].mark else NEXT / 4
            flow.add(i - 1, i, near, near)
    for e, node in held.items():
        if parents[e] in held:
            flow.add(node, held[parents[e]], DOM, DOM)
    return flow.cut(s, t)[:n]


def main_text(html: str | None, weights: np.ndarray) -> str:
    """The content blocks, in page order, joined by two line feeds; empty if there are none."""
    if not html:
        return ""
    blocks, parents = parse(html)
    return "\n\n".join(b.text for b, own in zip(blocks, label(blocks, parents, weights), strict=True) if own)


def extract(pages: DataFrame, weights: np.ndarray, *, html_column="html") -> DataFrame:
    """pages without html, with text (empty if none, also for null html) and n_chars (its code points), which replace columns of these names."""
    common.settle(pages.sparkSession)
    rest = [c for c in pages.columns if c not in (html_column, "text", "n_chars")]

    @F.pandas_udf("string")
    def text(html: pd.Series) -> pd.Series:
        return pd.Series([main_text(x, weights) for x in html], dtype="object")

    return pages.select(*rest, text(F.col(html_column)).alias("text")).withColumn("n_chars", F.char_length("text").cast("long"))
