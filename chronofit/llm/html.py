"""Main text of HTML pages by minimum-cut labelling of their text blocks.

A page becomes blocks of text in page order. A logistic classifier, fitted on pages that mark their article, gives
the cost of calling a block content or boilerplate; these are the capacities to the two terminals. Neighbours in
the page, and successive blocks of one parent, are tied by edges that weaken with their distance in the DOM and
where a part of the page begins or ends. The minimum cut is the labelling of least total cost.
"""

from __future__ import annotations

import html as _html
import re
from collections import defaultdict, deque
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

# Element names by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template textarea title iframe".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hr html li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul button label".split()
)
ENDS_P = BLOCK - {"br", "label", "button", "option", "optgroup"}
BAD_TAGS = frozenset("nav header footer aside form menu dialog button select fieldset search label option".split())
GOOD_TAGS = frozenset("article main".split())
PARTS = BAD_TAGS | GOOD_TAGS | {"section", "body"}
# Words of class and id names, and ARIA roles, that speak against or for content.
BAD_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices notification alert"
    " nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer header masthead topbar toolbar comment comments reply replies respond disqus"
    " social sharing related recommended newsletter subscribe subscription signup login popup modal overlay widget pagination pager copyright".split()
)
BAD_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
GOOD_NAMES = frozenset("article content post entry story main".split())
# Words that make a name say something of the layout or of a state, not of what the element is.
STATES = frozenset("has with without no not is open closed enabled disabled active free".split())

#: Features of a block, in this order, and the classifier's prior means in nats in favour of content.
PRIOR = {
    "bias": -1.0, "length": 3.0, "links": -3.0, "paragraph": 0.8, "heading": 0.2, "item": 0.0, "sentence": 1.0,
    "bad_tag": -8.0, "bad_name": -10.0, "outer_bad": -1.0, "hidden": -12.0, "good_tag": 3.0, "good_name": 1.5, "beside": -3.0,
}
_STRUCTURE = [list(PRIOR).index(x) for x in ("bad_tag", "bad_name", "outer_bad", "good_tag", "good_name", "beside")]
_TAGS = [list(PRIOR).index(x) for x in ("paragraph", "heading", "item")]
#: Spread of the prior (no weight moves from it by more than its square), and the pages (on average) and blocks, at most, that the classifier is fitted on.
SPREAD, FIT_PAGES, FIT_BLOCKS = 1.0, 1000, 20_000
#: Capacity between neighbours and between successive blocks of one parent at no distance; the share left across a part's border; the greatest cost of a block.
NEIGHBOUR, KIN, ACROSS, MOST = 6.0, 2.0, 0.1, 12.0

_TOKEN = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)", re.S)
# What follows a tag's name: a quote opens a value only after "="; it stops at ">", at the page's end or at a value that is never closed.
_REST = re.compile(r"(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|(?![\"'])))*+")
_ATTR = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'<>]+))?")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
_HEADING = re.compile(r"h[1-6]\Z")
_SENTENCE = re.compile(r"[.!?…。！？][\"'”’»)\]]*\Z")


def named(value: str) -> int:
    """What a class or id says of its element: -1 boilerplate, 1 content, 0 nothing.

    Each name counts by its first and last words, so "sidebar-left" and "site-footer" are boilerplate; "has-sidebar" or
    "comments-open" tell of the layout or a state, and say nothing.
    """
    said = 0
    for name in value.split():
        words = [w.lower() for w in _NAME.findall(name)]
        if not words or STATES.intersection(words):
            continue
        ends = {words[0], words[-1]}
        if ends & BAD_NAMES:
            return -1
        if ends & GOOD_NAMES:
            said = 1
    return said


@dataclass(slots=True)
class Element:
    """An open element and what holds for all text in it."""

    tag: str
    number: int
    depth: int
    part: int  # number of the innermost element that is a part of the page
    bad: bool = False  # inside a boilerplate element of the article, or of the page where there is no article
    outer: bool = False  # the article itself stands inside one
    good: bool = False
    name: int = 0  # of the nearest named element
    hidden: bool = False


def opened(tag: str, attributes: str, number: int, up: Element | None) -> Element:
    e = Element(tag, number, 0, number) if up is None else Element(tag, number, up.depth + 1, up.part, up.bad, up.outer, up.good, up.name, up.hidden)
    bad, good, said = tag in BAD_TAGS, tag in GOOD_TAGS, 0
    if tag == "header" and e.good:
        bad = False  # an article's own header holds its headline
    if attributes:
        for m in _ATTR.finditer(attributes):
            key = m[1].lower()
            if key not in ("class", "id", "role", "hidden", "aria-hidden", "style"):
                continue
            value = (m[2] or "").strip("\"'")
            if key in ("class", "id"):
                said = min(said, x) if (x := named(value)) < 0 or said < 0 else max(said, x)
            elif key == "role":
                bad, good = bad or value.lower() in BAD_ROLES, good or value.lower() in GOOD_TAGS
            elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and _HIDDEN.search(value.lower()):
                e.hidden = True
    if tag not in ("html", "body") and said:
        e.name = said
    if good:
        e.good, e.outer, e.bad = True, e.outer or e.bad or e.name < 0 and not said, False
        e.name = said
    if bad:
        e.bad = True
    if tag in PARTS or bad or said < 0:
        e.part = number
    return e


@dataclass(slots=True)
class Block:
    text: str
    links: float
    tag: str
    home: Element  # the innermost block element
    shared: int  # depth of the deepest element that also holds the block before


def blocks(page: str) -> list[Block]:
    """Text blocks in page order, in time and memory that follow the page's length and depth."""
    out: list[Block] = []
    stack: list[Element] = []
    homes: list[Element] = []  # those of the stack that are block elements
    text: list[str] = []
    linked, links, number, at, low = 0, 0, 0, 0, 0
    root = Element("body", 0, 0, 0)

    def flush() -> None:
        nonlocal linked, low
        if text:
            # character references are decoded before white space is folded, so that &nbsp; folds too
            raw = " ".join(_html.unescape("".join(text)).split())
            if raw:
                top = stack[-1] if stack else root
                home = homes[-1] if homes else root
                if top.hidden and not home.hidden:
                    home = top
                out.append(Block(raw, min(1.0, linked / len(raw)), home.tag, home, low))
                low = home.depth
            text.clear()
        linked = 0

    def close(k: int) -> None:
        nonlocal links, low
        for e in stack[k:]:
            links -= e.tag == "a"
            if e.tag in BLOCK:
                homes.pop()
        low = min(low, stack[k].depth - 1)
        del stack[k:]

    open_tags: dict[str, int] = defaultdict(int)
    unclosed: set[str] = set()  # raw elements that nothing closes any more
    size = len(page)
    while at < size:
        m = _TOKEN.search(page, at)
        if not m:
            text.append(page[at:])
            break
        if m.start() > at:
            piece = page[at : m.start()]
            text.append(piece)
            if links:
                linked += len(" ".join(piece.split()))
        at = m.end()
        if m[2] is None:
            continue
        rest = _REST.match(page, at).end()
        if rest < size and page[rest] != ">":  # no quote of its kind follows; the tag ends at the next bracket
            rest = page.find(">", rest)
        attributes = page[at:rest] if rest >= 0 else page[at:]
        at = min(size, rest + 1) if rest >= 0 else size
        tag = m[2].lower()
        if m[1]:
            if not open_tags[tag]:  # nothing to close; looking for it would walk the whole stack
                if tag in BLOCK:
                    flush()
                continue
            k = len(stack) - 1
            while stack[k].tag != tag:
                k -= 1
            if any(e.tag in BLOCK for e in stack[k:]):
                flush()
            for e in stack[k:]:
                open_tags[e.tag] -= 1
            close(k)
            continue
        if tag == "head":
            continue  # its parts are dropped one by one; an unclosed head must not swallow the page
        if tag in RAW:
            end = None if tag in unclosed else re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            if not end:
                unclosed.add(tag)
            if end or tag in ("script", "style"):
                at = end.end() if end else size
            continue
        if tag == "br":  # one is white space, two part blocks
            if text and text[-1] == "\n" or len(text) > 1 and text[-2] == "\n" and not text[-1].strip():
                flush()
            elif text:
                text.append("\n")
            continue
        if tag in BLOCK:
            flush()
        if tag in ENDS_P and homes:  # a paragraph ends where a block begins, and so do the inline elements left open in it
            last = homes[-1].tag
            if last == "p" or tag == last and tag in ("li", "option", "td", "th", "tr", "dd", "dt"):
                k = len(stack) - 1
                while stack[k] is not homes[-1]:
                    k -= 1
                for e in stack[k:]:
                    open_tags[e.tag] -= 1
                close(k)
        if tag in VOID:
            continue
        number += 1
        links += tag == "a"
        e = opened(tag, attributes, number, stack[-1] if stack else root)
        stack.append(e)
        open_tags[tag] += 1
        if tag in BLOCK:
            homes.append(e)
    flush()
    return out


def features(found: list[Block]) -> np.ndarray:
    """A row for each block of a page, in the order of PRIOR; "beside" is a block outside the article of a page that marks one."""
    marked = any(b.home.good and not b.home.outer and not b.home.bad and b.home.name >= 0 for b in found)
    rows = [
        [
            1.0, min(1.0, len(b.text) / 160), b.links, float(b.tag in ("p", "blockquote", "pre")), float(bool(_HEADING.match(b.tag))),
            float(b.tag in ("li", "td", "th", "dt", "dd")), float(bool(_SENTENCE.search(b.text))), float(b.home.bad), float(b.home.name < 0), float(b.home.outer),
            float(b.home.hidden), float(b.home.good), float(b.home.name > 0), float(marked and not b.home.good),
        ]
        for b in found
    ]
    return np.array(rows, float).reshape(-1, len(PRIOR))


def smoothness(found: list[Block]) -> dict[tuple[int, int], float]:
    """Undirected edges: neighbours in the page, a heading closest to what follows it, and successive blocks of one parent; the further apart in the DOM the weaker, and weak across a part's border and between links and text."""
    edges: dict[tuple[int, int], float] = {}
    last: dict[int, int] = {}
    for i, b in enumerate(found):
        if i:
            a = found[i - 1]
            apart = 0 if _HEADING.match(a.tag) else a.home.depth + b.home.depth - 2 * b.shared  # a heading belongs to what follows it
            edges[i - 1, i] = NEIGHBOUR / (1 + apart) * (1.0 if a.home.part == b.home.part else ACROSS) * (1 - abs(a.links - b.links))
        j = last.get(b.home.part)
        if j is not None and j != i - 1:
            edges[j, i] = KIN / 3
        last[b.home.part] = i
    return edges


def minimum_cut(unary: list[float], edges: dict[tuple[int, int], float]) -> list[bool]:
    """Labels of least cost, True where content: sum of |unary| on the wrong side plus cut edges; ties are boilerplate.

    A block whose own cost outweighs all its edges can be labelled outright, which is exact; its edges become
    costs of its neighbours. What is left is solved by augmenting paths between the terminals.
    """
    n = len(unary)
    u = list(unary)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for (i, j), c in edges.items():
        near[i][j] = near[i].get(j, 0.0) + c
        near[j][i] = near[j].get(i, 0.0) + c
    label: list[bool | None] = [None] * n
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if label[i] is not None or abs(u[i]) < sum(near[i].values()):
            continue
        label[i] = u[i] > 0
        for j, c in near[i].items():
            u[j] += c if label[i] else -c
            del near[j][i]
            todo.append(j)
        near[i] = {}
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        side = source_side([u[i] for i in rest], rest, near)
        for i in rest:
            label[i] = i in side
    return [bool(x) for x in label]


def source_side(u: list[float], nodes: list[int], near: list[dict[int, float]]) -> set[int]:
    """The nodes that stay with the source after a greatest flow, by blocking flows over shortest paths.

    A node's positive cost is what the source may send it, a negative one what it may send to the sink.
    """
    have = {i: max(0.0, x) for i, x in zip(nodes, u, strict=True)}
    want = {i: max(0.0, -x) for i, x in zip(nodes, u, strict=True)}
    left = {i: dict(near[i]) for i in nodes}
    while True:
        level = {i: 0 for i in nodes if have[i] > 1e-12}
        line, reached = deque(level), False
        while line:
            x = line.popleft()
            if want[x] > 1e-12:
                reached = True
            for y, c in left[x].items():
                if c > 1e-12 and y not in level:
                    level[y] = level[x] + 1
                    line.append(y)
        if not reached:
            return set(level)
        arcs = {i: list(left[i]) for i in level}
        for start in [i for i, x in level.items() if not x]:
            path = [start]
            while path and have[start] > 1e-12:
                x = path[-1]
                if want[x] > 1e-12:
                    flow = min([have[start], want[x], *(left[a][b] for a, b in zip(path, path[1:], strict=False))])
                    have[start] -= flow
                    want[x] -= flow
                    for a, b in zip(path, path[1:], strict=False):
                        left[a][b] -= flow
                        left[b][a] = left[b].get(a, 0.0) + flow
                    path = [start]
                    continue
                while arcs[x] and not (left[x][arcs[x][-1]] > 1e-12 and level.get(arcs[x][-1]) == level[x] + 1):
                    arcs[x].pop()
                if arcs[x]:
                    path.append(arcs[x][-1])
                else:
                    path.pop()
                    if path:
                        arcs[path[-1]].pop()


def prior() -> np.ndarray:
    return np.array(list(PRIOR.values()))


def costs(found: list[Block], weights: np.ndarray) -> np.ndarray:
    """How much the classifier favours content for each block."""
    return np.clip(features(found) @ weights, -MOST, MOST)


def labelled(found: list[Block], weights: np.ndarray | None = None) -> tuple[np.ndarray, list[bool]]:
    """The classifier's costs of a page's blocks, and their labels by the minimum cut."""
    u = costs(found, prior() if weights is None else weights)
    return u, minimum_cut(u.tolist(), smoothness(found))


def main_text(page: str | None, weights: np.ndarray | None = None) -> str:
    found = blocks(page or "")
    return " ".join(b.text for b, k in zip(found, labelled(found, weights)[1], strict=True) if k)


def logistic(x: np.ndarray, y: np.ndarray, mean: np.ndarray, spread: float, rounds: int = 30) -> np.ndarray:
    """Weights of greatest posterior probability under a Gaussian prior, by Newton steps with halving."""
    value = lambda w: float(np.logaddexp(0, np.where(y > 0, -1, 1) * (x @ w)).sum() + ((w - mean) ** 2).sum() / (2 * spread**2))
    w = mean.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.eye(len(w)) / spread**2, x.T @ (p - y) + (w - mean) / spread**2)
        scale, old = 1.0, value(w)
        while scale > 1e-6 and value(w - scale * step) > old:
            scale /= 2
        w = w - scale * step
        if np.abs(scale * step).max() < 1e-8:
            break
    return w


def fit(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", fit_pages: int = FIT_PAGES, fit_blocks: int = FIT_BLOCKS) -> np.ndarray:
    """Weights of the classifier, fitted on the blocks of pages that mark their article or main part.

    About `fit_pages` pages, chosen by a hash of the id, and at most `fit_blocks` of their blocks are looked at. A block
    is labelled content where it stands in the marked part and in no boilerplate element. Half of the blocks, by
    hash, are learnt without the features that come from the marks, and half of these also without those of the block's
    tag, so that the text's own features count on pages without marks and paragraphs. The prior weighs as much as all
    rows together, whatever their number; features lie between 0 and 1, so no weight moves by more than SPREAD^2, and
    pages of one template, which a single feature separates, can't make it outweigh the others. With nothing to learn from (an empty table, null ids, no marks) the weights are the prior's.
    """
    small_batches(pages.sparkSession)
    p = pages.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{html_col}`").cast("string").alias("html")).where("id is not null and html is not null")
    share = F.pmod(F.xxhash64(F.lit("blocks"), "id"), F.lit(1 << 30)) < int(min(1.0, fit_pages / max(1, pages.count())) * (1 << 30))

    def run(batches):
        for b in batches:
            for i, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = blocks(page)
                if not any(x.home.good for x in found):
                    continue
                x = features(found)
                y = [x.home.good and not x.home.bad and x.home.name >= 0 and not x.home.hidden for x in found]
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(y)), pa.array(range(len(y)), pa.int64()), pa.array(y), pa.array([r.tobytes() for r in x], pa.binary())], names=["id", "no", "y", "x"])

    rows = p.where(share).mapInArrow(run, "id long, no long, y boolean, x binary").withColumn("o", F.xxhash64("id", "no")).orderBy("o", "id", "no").limit(fit_blocks).collect()
    if not rows:
        return prior()
    x = np.stack([np.frombuffer(bytes(r["x"]), float) for r in rows])
    x[np.ix_(np.array([r["o"] % 2 == 0 for r in rows]), _STRUCTURE)] = 0
    x[np.ix_(np.array([r["o"] % 4 == 0 for r in rows]), _TAGS)] = 0
    return logistic(x, np.array([float(r["y"]) for r in rows]), prior(), SPREAD / len(rows) ** 0.5)


def extract(pages: DataFrame, weights: np.ndarray | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_blocks, n_turned), a row for each input row: the main text of the whole page, blocks joined by one blank.

    weights are those of fit(), or the prior's. n_blocks counts the page's blocks, n_turned those whose label the cut
    decided against the classifier. A null or empty page, or one without content, has an empty text. Unclosed tags,
    cut-off pages and broken references are read as browsers do, as far as text goes; hidden elements, scripts, styles
    and templates have no text. Null ids and repeated rows are kept as they are.
    """
    small_batches(pages.sparkSession)

    def run(batches):
        for b in batches:
            text, total, turned = [], [], []
            for page in b.column(2).to_pylist():
                found = blocks(page or "")
                u, keep = labelled(found, weights)
                text.append(" ".join(x.text for x, k in zip(found, keep, strict=True) if k))
                total.append(len(found))
                turned.append(int(((u > 0) != np.array(keep, bool)).sum()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string()), pa.array(total, pa.int64()), pa.array(turned, pa.int64())], names=["id", "url", "text", "n_blocks", "n_turned"])

    c = lambda name: F.col(f"`{name}`")
    page = pages.select(c(id_col).cast("long").alias("id"), c(url_col).cast("string").alias("url"), c(html_col).cast("string").alias("html"))
    return page.mapInArrow(run, "id long, url string, text string, n_blocks long, n_turned long")
