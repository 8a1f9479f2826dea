"""Main text of web pages by minimum-cut labelling.

A page becomes a sequence of text blocks.  A small fixed classifier gives each
block the log odds of being content; they become its terminal capacities.
Neighbouring blocks and blocks below the same element are tied by smoothness
edges that weigh less the farther apart the blocks stand in the DOM.  The
minimum cut between content and boilerplate labels all blocks at once, so a
doubtful block follows its surroundings.

A block whose own capacity is at least the sum of its edges has its label in
every minimum cut; such blocks are fixed first and folded into their neighbours'
terminals, which is exact, and max-flow (Dinic) solves what is left.

Defined cases.  Null, empty and text-free html give the empty text.  Character
references are decoded, white space (also no-break spaces) inside a block becomes
one space.  Unclosed elements end where their container ends; an article ends
the reach of an unclosed menu before it.  Rows that repeat a page_id are
separate pages.  Pages are read whole.
"""

from __future__ import annotations

import re
from collections import deque
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plateau.llm import base

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>", re.S
)
_RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "xmp", "noframes"}
_HIDDEN = _RAW | {"head", "svg", "math", "object", "canvas", "audio", "video", "select", "option", "button", "datalist", "map"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "rp", "rt",
    "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_BAD_TAGS = {"nav", "header", "footer", "aside", "form", "menu", "dialog"}
_GOOD_TAGS = {"article", "main"}
_BAD_WORDS = set(
    "nav navbar navigation menu breadcrumb breadcrumbs header masthead topbar footer sidebar side aside rail widget ad ads advert adverts advertisement advertising sponsor "
    "sponsored promo promotion banner cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login register "
    "form search comment comments disqus reply replies respond discussion share sharing social related recommended recommendations trending popular pagination pager copyright "
    "legal disclaimer contentinfo complementary hidden".split()
)
_GOOD_WORDS = set("article content post entry story main body text".split())
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_ATTR = re.compile(r"(?:^|\s)(class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_ANY_ATTR = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
#: Classes that clip or turn, and hide nothing.
_CLIPS = re.compile(r"(?:overflow|backface)[\w-]*?hidden", re.I)
_ENDS = re.compile(r"[.!?…。]")

#: Fixed weights of the block classifier (log odds of content).
NEAR_GOOD, NEAR_BAD, FAR_BAD, LINKS, LONG, SHORT, SENTENCE, HEADING, PARAGRAPH, COPYRIGHT = 3.0, -5.0, -1.0, -2.5, 1.2, -0.8, 0.6, 1.0, 0.8, -2.0
#: Smoothness of neighbours, of blocks under one element, and its loss per step in the DOM.
ADJACENT, SIBLING, PER_STEP = 1.0, 0.6, 0.5


class _Element:
    __slots__ = ("name", "depth", "serial", "near", "far_bad", "link", "hidden", "block", "parent")

    def __init__(self, name, parent, serial, role, hidden):
        self.name, self.serial, self.parent = name, serial, parent
        self.depth = parent.depth + 1 if parent else 0
        self.near = role or (parent.near if parent else 0)
        self.far_bad = role < 0 or bool(parent and parent.far_bad)
        self.link = name == "a" or bool(parent and parent.link)
        self.hidden = hidden or bool(parent and parent.hidden)
        self.block = parent.block if parent and name in _INLINE else self


def _role(name: str, attributes: str) -> int:
    """1: holds content, -1: holds boilerplate, 0: nothing known."""
    if name in _BAD_TAGS:
        return -1
    good = name in _GOOD_TAGS
    if attributes and name not in ("html", "body"):
        words = {w.lower() for m in _ATTR.finditer(attributes) for w in _WORDS.findall(_CLIPS.sub(" ", m[2] or m[3] or m[4] or ""))}
        if words & _BAD_WORDS and not (name in _HEADINGS and words & _BAD_WORDS <= {"header"}) and not good:
            return -1
        good = good or bool(words & _GOOD_WORDS)
    return 1 if good else 0


def _hides(attributes: str) -> bool:
    """An attribute named hidden, aria-hidden that is true, or a style that says display: none or visibility: hidden last."""
    seen = {}
    for m in _ANY_ATTR.finditer(attributes):
        seen.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    if "hidden" in seen or seen.get("aria-hidden", "").strip().lower() == "true":
        return True
    said, firm = {}, set()
    for declaration in _COMMENT.sub(" ", unescape(seen.get("style", ""))).lower().split(";"):
        name, _, value = declaration.partition(":")
        name, (value, important, _) = name.strip(), value.partition("!")
        if important or name not in firm:
            said[name] = value.strip()
        if important:
            firm.add(name)
    return said.get("display") == "none" or said.get("visibility") == "hidden"


def blocks(page: str) -> list[tuple[str, _Element, int, bool]]:
    """(text, element, characters inside links, any words) of every block with text."""
    out, parts, linked = [], [], 0
    root = top = _Element("", None, 0, 0, False)
    serial, at, owner = 0, 0, None

    def flush():
        nonlocal linked, owner
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append((text, owner.block, linked))
            parts.clear()
        linked, owner = 0, None

    def say(raw):
        nonlocal linked, owner
        if top.hidden or not raw:
            return
        text = unescape(raw) if "&" in raw else raw
        if owner is None and not text.isspace():
            owner = top
        if owner is not None or parts:
            parts.append(text)
        if top.link:
            linked += len(text.strip())

    find = _TAG.search
    while m := find(page, at):
        say(page[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if name is None:
            continue
        name, closing, attributes = name.lower(), m[1] or m[4], m[3] if m[2] else m[6]
        if name not in _INLINE:
            flush()
        if closing:
            e = top
            while e is not root and e.name != name:
                e = e.parent
            if e is not root:
                top = e.parent
            continue
        if name in _VOID:
            continue
        if name not in _INLINE:
            if name == "body" or name in _BAD_TAGS or name in _GOOD_TAGS or name in ("div", "p", "section"):
                e = top
                while e is not root and e.name != "head":
                    e = e.parent
                if e is not root:
                    top = e.parent
            if top.block.name == "p" or top.block.name == name and name in ("li", "dt", "dd", "tr", "td", "th", "option"):
                top = top.block.parent
        serial += 1
        low = (attributes or "").lower()
        hidden = name in _HIDDEN or ("hidden" in low or "style" in low) and _hides(attributes)
        if low.endswith("/") and name in ("svg", "math"):
            continue
        top = _Element(name, top, serial, _role(name, attributes), hidden)
        if name in _RAW:
            end = re.compile(rf"</{name}[\s/>]", re.I).search(page, at)
            at = end.start() if end else len(page)
    say(page[at:])
    flush()
    return out


def log_odds(text: str, e: _Element, linked: int) -> float:
    words = text.count(" ") + 1
    share = min(1.0, linked / len(text))
    v = NEAR_GOOD if e.near > 0 else NEAR_BAD if e.near < 0 else 0.0
    if e.near > 0 and e.far_bad:
        v += FAR_BAD
    if e.name in _HEADINGS:
        v += HEADING
    elif e.name in ("p", "blockquote", "pre", "td", "li", "dd") and share < 0.5:
        v += PARAGRAPH
    if share > 0.6:
        v += LINKS
    if words >= 12:
        v += LONG
    elif words < 4 and e.name not in _HEADINGS and e.name != "p":
        v += SHORT
    if _ENDS.search(text):
        v += SENTENCE
    if text[0] == "©" or text.startswith("(c)"):
        v += COPYRIGHT
    return v


def _steps(a: _Element, b: _Element) -> int:
    """Elements between two blocks in the tree."""
    n = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        n += 1
    return n


def minimum_cut(terminal: list[float], edges: dict[tuple[int, int], float]) -> list[bool]:
    """Labels of the minimum cut: cost |terminal| for going against its sign, the edge's weight for two unlike ends.

    Ties go to content.
    """
    n = len(terminal)
    t, near = list(terminal), [{} for _ in range(n)]
    for (i, j), w in edges.items():
        near[i][j] = near[i].get(j, 0.0) + w
        near[j][i] = near[j].get(i, 0.0) + w
    label: list[bool | None] = [None] * n
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if label[i] is None and abs(t[i]) >= sum(near[i].values()):
            label[i] = t[i] >= 0
            for j, w in near[i].items():
                del near[j][i]
                t[j] += w if label[i] else -w
                todo.append(j)
            near[i] = {}
    left = [i for i in range(n) if label[i] is None]
    if left:
        for i, reached in zip(left, _source_side(left, t, near), strict=True):
            label[i] = reached
    return label


def _source_side(left, t, near) -> list[bool]:
    """Dinic's max-flow; what the source can still reach, or the sink cannot be reached from, is content."""
    at = {i: k for k, i in enumerate(left)}
    s, e = len(left), len(left) + 1
    graph: list[dict[int, float]] = [{} for _ in range(len(left) + 2)]
    for i in left:
        k = at[i]
        if t[i] > 0:
            graph[s][k], graph[k][s] = t[i], 0.0
        elif t[i] < 0:
            graph[k][e], graph[e][k] = -t[i], 0.0
        for j, w in near[i].items():
            graph[k][at[j]] = w
    tiny = 1e-12
    while True:
        level, queue = {s: 0}, deque([s])
        while queue:
            u = queue.popleft()
            for v, c in graph[u].items():
                if c > tiny and v not in level:
                    level[v] = level[u] + 1
                    queue.append(v)
        if e not in level:
            break
        todo = [list(g) for g in graph]
        path = [s]
        while path:
            u = path[-1]
            if u == e:
                push = min(graph[a][b] for a, b in zip(path, path[1:]))
                for a, b in zip(path, path[1:]):
                    graph[a][b] -= push
                    graph[b][a] = graph[b].get(a, 0.0) + push
                cut = next(k for k, (a, b) in enumerate(zip(path, path[1:])) if graph[a][b] <= tiny)
                del path[cut + 1 :]
                continue
            while todo[u]:
                v = todo[u][-1]
                if graph[u][v] > tiny and level.get(v, -1) == level[u] + 1:
                    path.append(v)
                    break
                todo[u].pop()
            else:
                path.pop()
                if path:
                    todo[path[-1]].pop()
    # what can still reach the sink is boilerplate
    back, queue = {e}, deque([e])
    while queue:
        v = queue.popleft()
        for u in graph[v]:
            if u not in back and graph[u].get(v, 0.0) > tiny:
                back.add(u)
                queue.append(u)
    return [k not in back for k in range(len(left))]


def extract(page: str | None) -> str:
    if not page:
        return ""
    found = blocks(page)
    edges, last = {}, {}
    for i, (_, e, _) in enumerate(found):
        if i:
            edges[i - 1, i] = ADJACENT * PER_STEP ** max(0, _steps(found[i - 1][1], e) - 2)
        parent = e.parent.serial if e.parent else -1
        if parent in last and last[parent] != i - 1:
            edges[last[parent], i] = SIBLING
        last[parent] = i
    labels = minimum_cut([log_odds(*b) for b in found], edges)
    return " ".join(b[0] for b, keep in zip(found, labels, strict=True) if keep)


def extract_text(pages: DataFrame, keep="*", html: str = "html") -> DataFrame:
    """row (the kept columns) and text."""
    rows = base.packed(pages, keep, html=F.col(f"`{html}`").cast("string"))

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([extract(h.as_py()) for h in b.column(1)], pa.string())], ["row", "text"])

    return rows.mapInArrow(run, base.schema_of(rows, "text string"))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract_text(base.table(spark, sf_dir, "pages"), keep=["page_id", "url"])
    return found.select("row.page_id", "row.url", "text", F.char_length("text").cast("bigint").alias("n_chars"))


QUERIES = {"op4_html_text": op4_html_text}
ORACLES: dict[str, str] = {}
