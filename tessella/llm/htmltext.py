"""Main text of HTML pages by minimum cuts.

A page is cut into text blocks in page order.  A small classifier gives every
block a cost of being called content and one of being called boilerplate;
these are its capacities from the source and to the sink.  Blocks that follow
one another, and blocks of one parent, are joined by smoothness edges that
grow with their closeness in the tree.  The maximum flow separates content
from boilerplate.  Blocks in elements that are no prose by their own meaning
(menus, footers, forms, scripts, ...) have a prohibitive cost.

The classifier is linear in a block's features: words, share of link text, kind
of element, and what the names around it hint at.  No labelled pages exist, so
its weights (WEIGHTS) are set by hand.  Names that mean a place that is no part
of an article (an advert, a comment) weigh more than any prose; names that only
hint at one (social, legal) give way to prose of some twenty words.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, release, text_of

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"\w+")
# Element names of the HTML standard.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template textarea title iframe noembed noframes svg math object canvas xmp".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_CLOSES_P = _BLOCK - frozenset("body head html caption dd dt figcaption legend li summary tbody td tfoot th thead tr".split())
_NEVER = frozenset("nav footer aside form select button menu dialog input label option head fieldset".split())
_GOOD = frozenset("article main".split())
_BAD_NAME = re.compile(r"(?:^|[\s_-])(?:ad|ads|advert\w*|banner|sponsor\w*|promo\w*|nav\w*|menu\w*|breadcrumb\w*|footer|header|masthead|topbar|sidebar|widget|cookie\w*|consent|gdpr|notice|popup|modal|newsletter|subscribe|signup|login|related|recommend\w*|comment|comments|commentlist|disqus|reply|respond|pagination|pager|hidden)(?=$|[\s_-])", re.I)
_WEAK_NAME = re.compile(r"(?:^|[\s_-])(?:foot|side|aside|share|sharing|social|toolbar|skip|legal|copyright|disclaimer|tags)(?=$|[\s_-])", re.I)
_HEADS = frozenset(("header", "masthead"))  # inside an article they hold its title
_GOOD_NAME = re.compile(r"(?:^|[\s_-])(?:article\w*|content|entry|post|story|body|main|text)(?=$|[\s_-])", re.I)
_HIDDEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
NEVER = 1e6
_EPS = 1e-9
#: Cost of calling a block boilerplate: prose, word (times log(1 + words), as far as they are no links), good, text; content: junk, link, bad, weak, item.
WEIGHTS = {"prose": 0.4, "word": 1.0, "good": 4.0, "text": 0.5, "junk": 0.8, "link": 4.0, "bad": 20.0, "weak": 3.0, "item": 0.3}


class Node:
    """An element; ``block`` is the innermost block element it stands in, itself included."""

    __slots__ = ("tag", "parent", "depth", "bad", "good", "block")

    def __init__(self, tag: str, parent: "Node | None", attrs: str = ""):
        self.tag, self.parent = tag, parent
        self.block = self if tag in _BLOCK or parent is None else parent.block
        self.depth = parent.depth + 1 if parent else 0
        self.bad = parent.bad if parent else 0.0
        self.good = parent.good if parent else 0.0
        if tag in _NEVER or tag == "header" and not (parent and parent.good):
            self.bad = NEVER
        elif tag in _GOOD:
            self.good = 1.0
        if attrs:
            names = ""
            for m in _ATTR.finditer(attrs):
                name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
                if name in ("class", "id", "role"):
                    names += " " + value
                elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and _HIDDEN_STYLE.search(value):
                    self.bad = NEVER
            if names and tag not in ("html", "body"):
                if (m := _BAD_NAME.search(names)) and not (self.good and m[0].strip(" _-").lower() in _HEADS):
                    self.bad = max(self.bad, WEIGHTS["bad"])
                elif _WEAK_NAME.search(names):
                    self.bad = max(self.bad, WEIGHTS["weak"])
                elif _GOOD_NAME.search(names):
                    self.good = max(self.good, 0.5)


def blocks(page: str) -> list[tuple[str, Node, int]]:
    """(text, innermost block element, characters in links) of each block, in page order.

    Broken markup is read leniently: stray end tags are ignored, open elements
    end with their parent, a paragraph ends where another block begins.
    """
    out: list[tuple[str, Node, int]] = []
    root = Node("html", None)
    stack, opened = [root], Counter()
    held: list[str] = []
    owner, linked, in_link = root, 0, 0

    def flush() -> None:
        nonlocal held, linked
        if held:
            text = _SPACE.sub(" ", html.unescape("".join(held))).strip()
            if text:
                out.append((text, owner, linked))
            held, linked = [], 0

    def say(s: str) -> None:
        nonlocal owner, linked
        if s:
            if not held:
                owner = stack[-1].block
            held.append(s)
            if in_link:
                linked += len(html.unescape(s).strip())

    def close(n: int) -> None:
        """End the elements from the n-th open one on."""
        nonlocal in_link
        for node in stack[n:]:
            opened[node.tag] -= 1
            in_link -= node.tag == "a"
        del stack[n:]

    def innermost(tag: str) -> int:
        return next(i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag)

    at = 0
    while m := _TAG.search(page, at):
        say(page[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if tag == "br":
                say(" ")
            elif opened[tag] > 0:
                if tag in _BLOCK:
                    flush()
                close(innermost(tag))
            continue
        if tag in _RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            if not (m[3] or "").rstrip().endswith("/"):
                at = end.end() if end else len(page)
            continue
        if tag in _BLOCK:
            flush()
            if tag in ("html", "body") and len(stack) > 1 and (opened[tag] > 0 or tag == "html"):
                continue
            if tag in _CLOSES_P and opened["p"] > 0:
                close(innermost("p"))
            elif tag in ("li", "dd", "dt", "td", "th", "tr", "option"):
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag in ("ul", "ol", "dl", "menu", "table", "tbody", "thead", "tfoot") or tag in ("td", "th") and stack[i].tag == "tr":
                        break
                    if stack[i].tag == tag or {stack[i].tag, tag} <= {"dd", "dt"} or {stack[i].tag, tag} <= {"td", "th"} or tag == "tr" and stack[i].tag in ("td", "th"):
                        close(i)
            if tag == "hr":
                continue
        elif tag == "br":
            say(" ")
            continue
        elif tag in _VOID:
            continue
        if tag == "a":
            in_link += 1
        opened[tag] += 1
        stack.append(Node(tag, stack[-1], m[3] or ""))
    say(page[at:])
    flush()
    return out


def costs(text: str, node: Node, linked: int) -> tuple[float, float]:
    """(cost of calling the block boilerplate, cost of calling it content)."""
    w = WEIGHTS
    share = min(1.0, linked / max(1, len(text)))
    prose = w["prose"] + w["word"] * math.log1p(len(_WORD.findall(text))) * (1 - share) + w["good"] * node.good
    junk = w["junk"] + w["link"] * share + node.bad
    if node.tag in ("li", "td", "th", "dd", "dt"):
        junk += w["item"]
    if node.tag in ("h1", "h2", "h3", "p", "blockquote", "pre"):
        prose += w["text"]
    return prose, junk


def edges(found: list[tuple[str, Node, int]]) -> list[tuple[int, int, float]]:
    """Smoothness between neighbours in page order, and between blocks of one parent."""
    out, last = [], {}
    for i, (_, n, _) in enumerate(found):
        if i:
            a, b, steps = found[i - 1][1], n, 0
            while a is not b:
                if a.depth >= b.depth:
                    a = a.parent
                else:
                    b = b.parent
                steps += 1
            out.append((i - 1, i, 1.2 / (1 + steps)))
        p = id(n.parent)
        if p in last and last[p] != i - 1:
            out.append((last[p], i, 0.4))
        last[p] = i
    return out


def min_cut(prose: list[float], junk: list[float], links: list[tuple[int, int, float]]) -> list[bool]:
    """Content side of a minimum cut: sum of junk over content, of prose over the rest, of links across; of several the smallest content.

    Direct flow from source over a block to the sink goes first.  A block whose
    rest outweighs all its edges is on its side in every minimum cut; its edges
    become capacities of its neighbours, and so on.  On what is left the maximum
    flow is sought.
    """
    n = len(prose)
    net = [a - b for a, b in zip(prose, junk, strict=True)]  # > 0: left from the source; < 0: left to the sink
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for i, j, c in links:
        if c > 0 and i != j:
            near[i][j] = near[i].get(j, 0.0) + c
            near[j][i] = near[j].get(i, 0.0) + c
    pull = [sum(x.values()) for x in near]
    side: list[bool | None] = [None] * n
    todo = list(range(n))
    while todo:
        i = todo.pop()
        if side[i] is None and abs(net[i]) > pull[i] + _EPS:
            side[i] = net[i] > 0
            for j, c in near[i].items():
                if side[j] is None:
                    net[j] += c if side[i] else -c
                    pull[j] -= c
                    todo.append(j)
    open_ = [i for i in range(n) if side[i] is None]
    if open_:
        place = {i: k for k, i in enumerate(open_)}
        rest = [(place[i], place[j], c) for i in open_ for j, c in near[i].items() if i < j and side[j] is None]
        for i, content in zip(open_, _reached([net[i] for i in open_], rest), strict=True):
            side[i] = content
    return [bool(x) for x in side]


def _reached(net: list[float], links: list[tuple[int, int, float]]) -> list[bool]:
    """What a maximum flow leaves reachable from the source: flows along shortest paths, all paths of one length in a phase."""
    n = len(net)
    source, sink = n, n + 1
    out: list[list[int]] = [[] for _ in range(n + 2)]  # arcs; an arc's number with the last bit turned is its reverse
    to: list[int] = []
    room: list[float] = []

    def arc(i: int, j: int, there: float, back: float) -> None:
        out[i].append(len(to))
        out[j].append(len(to) + 1)
        to.extend((j, i))
        room.extend((there, back))

    for i, x in enumerate(net):
        if x > _EPS:
            arc(source, i, x, 0.0)
        elif x < -_EPS:
            arc(i, sink, -x, 0.0)
    for i, j, c in links:
        arc(i, j, c, c)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        todo = deque([source])
        while todo:
            i = todo.popleft()
            for a in out[i]:
                j = to[a]
                if level[j] < 0 and room[a] > _EPS:
                    level[j] = level[i] + 1
                    todo.append(j)
        if level[sink] < 0:
            return [x >= 0 for x in level[:n]]
        now = [0] * (n + 2)  # the next arc to try
        path: list[int] = []
        i = source
        while True:
            if i == sink:
                flow = min(room[a] for a in path)
                for a in path:
                    room[a] -= flow
                    room[a ^ 1] += flow
                # go back to where the path is broken
                cut = next(k for k, a in enumerate(path) if room[a] <= _EPS)
                i = to[path[cut] ^ 1]
                del path[cut:]
                continue
            arcs, k = out[i], now[i]
            while k < len(arcs) and not (room[arcs[k]] > _EPS and level[to[arcs[k]]] == level[i] + 1):
                k += 1
            now[i] = k
            if k < len(arcs):
                path.append(arcs[k])
                i = to[arcs[k]]
            elif path:
                i = to[path.pop() ^ 1]
                now[i] += 1
            else:
                break


def main_text(page: str | None) -> str:
    """Content blocks joined by a line feed; null and pages without content give an empty text."""
    found = blocks(page or "")
    if not found:
        return ""
    prose, junk = zip(*(costs(*b) for b in found), strict=True)
    keep = min_cut(list(prose), list(junk), edges(found))
    return "\n".join(b[0] for b, k in zip(found, keep, strict=True) if k)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row; other columns are not looked at."""

    bounded(pages.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            text = [main_text(h) for h in b.pop("html")]
            yield b.assign(text=text, n_chars=np.array([len(t) for t in text], np.int64))
        release()

    return pages.select("page_id", "url", text_of(F.col("html")).alias("html")).mapInPandas(run, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")
