"""Main text of web pages by minimum-cut labelling of their blocks.

A page becomes a list of text blocks with their place in the tree.  A linear
classifier over tags, class names, links and prose, whose weights are set by
hand and not fitted, gives each block the cost of either label; these costs are the terminal capacities of a flow network.
Neighbouring blocks are tied by smoothness edges, the closer in the tree the
stronger.  The minimum cut, found by max-flow, is the cheapest labelling of
the whole page: blocks left on the source's side are its main text.
"""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from edgeframe.llm import textops
from edgeframe.llm.shared import batched, named

# HTML's element kinds.
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = "script|style|noscript|template|textarea|title|iframe|svg|math|canvas|object|noembed|noframes|audio|video"
#: What a start tag closes, up to the element that holds such items.
_IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}

_TOKEN = re.compile(rf"""<!--.*?(?:--!?>|\Z)|<({_RAW})\b(?:"[^"]*"|'[^']*'|[^>"'])*+>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>"'])*+>|[^>]*(?:>|\Z))|<[!?/][^>]*(?:>|\Z)|([^<]+|<)""", re.DOTALL | re.IGNORECASE)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|style|hidden|aria-hidden|aria-label|itemprop)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""", re.IGNORECASE)
_NAME = re.compile(r"[a-z]+")

# Words of class names, ids and roles.
_AWAY = frozenset("ad ads adv advert adverts advertisement advertising adbox adslot banner breadcrumb breadcrumbs byline captcha colophon comment comments commentlist complementary consent contentinfo cookie cookies copyright disqus dropdown footer form gdpr hidden login masthead menu meta modal nav navbar navigation newsletter notice notification notifications overlay pager pagination popup promo promoted promotion recommend recommended related replies reply respond search share sharing sidebar sidenav signup skip social sponsor sponsored subscribe subscription tags toolbar topbar widget widgets".split())
_MAIN = frozenset("article articlebody content entry main maincontent post postcontent story text".split())
_AWAY_TAGS = frozenset("nav footer aside form dialog menu select option search fieldset".split())
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))

#: Weights of the classifier, in units of capacity; above 0 speaks for main text.
AWAY, MAIN, LINKS, PROSE, SHORT, HEADING, BIAS = -90, 60, -50, 30, -6, 10, -6
#: Smoothness between neighbours that are siblings; halves with each step apart in the tree.
SMOOTH = 16


class _Element:
    __slots__ = ("away", "depth", "main", "name", "parent")

    def __init__(self, name: str, parent: _Element | None, rest: str):
        self.name, self.parent = name, parent
        self.depth = parent.depth + 1 if parent else 0
        self.away, self.main = (parent.away, parent.main) if parent else (False, False)
        if name in _AWAY_TAGS or (name == "header" and not self.main):
            self.away = True
        elif name in ("article", "main"):
            self.main = True
        if rest and name not in ("html", "body"):
            for key, a, b, c in _ATTRIBUTE.findall(rest):
                key, value = key.lower(), (a or b or c).lower()
                if key == "style":
                    self.away |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value))
                elif key in ("hidden", "aria-hidden"):
                    self.away |= value != "false"
                else:
                    words = set(_NAME.findall(value))
                    if words & _AWAY and not (name in ("article", "main") and words & _MAIN):
                        self.away = True
                    elif words & _MAIN:
                        self.main = True


class _Block:
    __slots__ = ("element", "links", "text")

    def __init__(self, element: _Element, text: str, links: int):
        self.element, self.text, self.links = element, text, links


def blocks(page: str) -> list[_Block]:
    """The text blocks of a page in order, references decoded, white space collapsed."""
    out: list[_Block] = []
    top = _Element("html", None, "")
    held: list[tuple[str, bool]] = []
    link: int | None = None  # depth at which a link is open

    def flush() -> None:
        if held:
            if text := " ".join("".join(s for s, _ in held).split()):
                out.append(_Block(top, text, sum(len(s.strip()) for s, linked in held if linked)))
            held.clear()

    for token in _TOKEN.finditer(page):
        text = token[5]
        if text is not None:
            held.append((html.unescape(text) if "&" in text else text, link is not None))
            continue
        name = token[3]
        if name is None:
            continue
        name = name.lower()
        if name == "a":
            link = None if token[2] else top.depth
        elif name == "br" or name == "img":
            held.append((" ", False))
        elif name in _BLOCK:
            flush()
            if token[2]:
                at = top
                while at.parent and at.name != name:
                    at = at.parent
                if at.name == name and at.parent:
                    top = at.parent
            else:
                if top.name == "p" and name not in ("option", "select"):
                    top = top.parent
                if name in _IMPLIED:
                    closes, within = _IMPLIED[name]
                    at = top
                    while at.parent and at.name not in within and at.name not in closes:
                        at = at.parent
                    while at.parent and at.name in closes:
                        top = at = at.parent
                if name not in _VOID:
                    top = _Element(name, top, token[4].rstrip(">"))
            if link is not None and top.depth < link:
                link = None
    flush()
    return out


_SENTENCE = re.compile(r"[.!?…。！？](?:\s|$|[\"'»”)])")


def cost(block: _Block) -> int:
    """The classifier's score: above 0 for main text."""
    text, element = block.text, block.element
    size = len(text)
    words = text.count(" ") + 1
    score = BIAS
    if element.away:
        score += AWAY
    if element.main:
        score += MAIN
    score += int(LINKS * min(1.0, block.links / size))
    if element.name in _HEADINGS:
        score += HEADING
    elif words < 6:
        score += SHORT
    if _SENTENCE.search(text):
        score += min(PROSE, 2 * words)
    elif words >= 20:
        score += PROSE // 2
    return score


def _distance(a: _Element, b: _Element) -> int:
    """Steps in the tree between two elements."""
    steps = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return steps


def _edges(found: list[_Block]) -> list[tuple[int, int, int]]:
    """Smoothness between blocks next to each other and next under one parent."""
    out, last = [], {}
    for i, block in enumerate(found):
        if i and (weight := SMOOTH >> max(0, _distance(found[i - 1].element, block.element) - 2)):
            out.append((i - 1, i, weight))
        parent = block.element.parent
        if (j := last.get(id(parent))) is not None and j < i - 1:
            out.append((j, i, SMOOTH // 2))
        last[id(parent)] = i
    return out


def minimum_cut(scores: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Which nodes stay with the source when the cut is cheapest; of several cheapest cuts the smallest side.

    A node with score s > 0 is tied to the source by s, otherwise to the sink
    by -s; edges bind both ways.  Nodes with two neighbours at most are
    contracted first: the flow through such a node becomes flow from or to its
    neighbours and between them.  Blocks of a page tie to the one before and to
    the last one under the same parent, so contraction takes nearly all of them
    and the time grows with the page; max-flow cuts what is left.
    """
    n = len(scores)
    scores = list(scores)
    near: list[dict[int, int]] = [{} for _ in range(n)]  # near[a][b]: the price of a at the source and b at the sink
    for a, b, weight in edges:
        near[a][b] = near[a].get(b, 0) + weight
        near[b][a] = near[b].get(a, 0) + weight
    gone: list[tuple] = []
    done = [False] * n
    todo = [i for i in range(n) if len(near[i]) <= 2]
    while todo:
        v = todo.pop()
        if done[v] or len(near[v]) > 2:
            continue
        done[v] = True
        ties = [(a, near[v][a], near[a][v]) for a in near[v]]  # neighbour, v at the source alone, neighbour alone
        gone.append((v, scores[v], ties))
        for a, _, _ in ties:
            del near[a][v]
        s = scores[v]
        if len(ties) == 1:
            (a, va, av), = ties
            # the least price of v, its neighbour at the sink (0) or the source (1)
            scores[a] += min(0, -s + va) - min(av, -s)
        elif len(ties) == 2:
            (a, va, av), (b, vb, bv) = ties
            p00, p10, p01, p11 = min(0, -s + va + vb), min(av, -s + vb), min(bv, -s + va), min(av + bv, -s)
            scores[a] -= p11 - p01
            scores[b] -= p01 - p00
            near[a][b] = near[a].get(b, 0) + p10 + p01 - p00 - p11
            near[b].setdefault(a, 0)
        todo += [a for a, _, _ in ties if len(near[a]) <= 2]
    rest = [i for i in range(n) if not done[i]]
    side = _max_flow(rest, scores, near)
    for v, s, ties in reversed(gone):
        # at the source only where that is cheaper
        side[v] = sum(0 if side[a] else va for a, va, _ in ties) - s < sum(av if side[a] else 0 for a, _, av in ties)
    return [side[i] for i in range(n)]


def _max_flow(nodes: list[int], scores: list[int], near: list[dict[int, int]]) -> dict[int, bool]:
    """The source's side of the nodes, by shortest augmenting paths; what the source still reaches is its side."""
    over = {i: max(0, scores[i]) for i in nodes}  # left in the edge from the source
    under = {i: max(0, -scores[i]) for i in nodes}  # left in the edge to the sink
    while True:
        came: dict[int, int] = {i: -1 for i in nodes if over[i]}
        queue, end = deque(came), -1
        while queue:
            i = queue.popleft()
            if under[i]:
                end = i
                break
            for j, room in near[i].items():
                if room and j not in came:
                    came[j] = i
                    queue.append(j)
        if end < 0:
            return {i: i in came for i in nodes}
        path = [end]
        while came[path[-1]] >= 0:
            path.append(came[path[-1]])
        path.reverse()
        flow = min(over[path[0]], under[end], *(near[a][b] for a, b in zip(path, path[1:], strict=False)))
        over[path[0]] -= flow
        under[end] -= flow
        for a, b in zip(path, path[1:], strict=False):
            near[a][b] -= flow
            near[b][a] += flow


def main_text(page: str) -> str:
    """The main text, blocks joined by newlines."""
    found = blocks(page)
    kept = minimum_cut([cost(b) for b in found], _edges(found))
    return "\n".join(b.text for b, keep in zip(found, kept, strict=True) if keep)


def extract_main_text(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` with ``text`` and ``n_chars`` instead of the markup.

    A null or empty page, or one without main text, gives an empty text.  Other
    columns are kept, but for those named like the new ones, which are
    replaced; repeated rows are treated alike.  Broken markup and cut-off pages
    are read as far as they go.  An empty table gives an empty result.
    """
    rest, keep = batched(pages, html_col, "text", "n_chars")
    out = T.StructType([*(T.StructField(f"c{i}", f.dataType) for i, f in enumerate(keep)), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textops.slices(batch, "text"):
                texts = [main_text(page) if page else "" for page in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string()), pa.array(np.array([len(t) for t in texts], np.int64))], out.fieldNames())

    return named(rest.mapInArrow(rows, out), keep)


def op7(spark, sf_dir: str) -> DataFrame:
    """Contract query over all of ``pages``."""
    return extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
