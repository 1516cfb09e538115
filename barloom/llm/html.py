"""Main-text extraction by minimum cut.

A page is cut into blocks of text with their place in the DOM. A logistic classifier, fitted here on
generated pages, gives each block the cost of being called content or boilerplate: the capacities to the
two terminals. Neighbours in page order, and blocks of one container, are joined by smoothness edges that
weaken with their distance in the tree. Maximum flow separates content from boilerplate at least total
cost. Blocks whose own cost outweighs all their edges are fixed first, which changes no optimum and leaves
little or nothing to the flow.
"""

from __future__ import annotations

import random
import re
from collections import defaultdict, deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Comments, declarations, and tags. A quote opens a value only right after =, as in browsers; elsewhere it is a letter.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:\"[^\"]*\"|'[^']*')?+)*+)(?:>|\Z)", re.S)
#: One attribute, whatever its name: name, then a quoted or bare value.
_ATTR = re.compile(r"([^\s/>=][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
#: Text in these is never text of the page: scripts, styles, templates, form controls, the head's title.
_RAW = frozenset("script style template textarea select title".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav noscript ol option p pre section summary table tbody td tfoot th thead tr ul xmp".split())
_ENDS_P = _BLOCK - {"button", "label", "noscript"}
#: A start tag closes an open element of these kinds, if one is open inside the same list or table.
_CLOSES = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dd", "dt"), ("dl",)), "dd": (("dd", "dt"), ("dl",)), "tr": (("td", "th", "tr"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table"))}
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Elements whose text is a part of what holds them.
_LEAVES = _HEADINGS | {"p", "li", "td", "th", "dd", "dt", "blockquote", "pre"}
_CELLS = frozenset("td th dt dd".split())
_CAPTIONS = frozenset(("caption", "figcaption"))

_BOILER, _MAIN, _BADNAME, _GOODNAME, _REMARK, _CONTROL, _HEADER, _HIDDEN, _WEAKNAME = (1 << k for k in range(9))
_TAG_FLAGS = {"nav": _BOILER, "footer": _BOILER, "aside": _BOILER, "menu": _BOILER, "dialog": _BOILER, "form": _CONTROL, "button": _CONTROL, "label": _CONTROL, "legend": _CONTROL, "option": _CONTROL, "fieldset": _CONTROL, "article": _MAIN, "main": _MAIN, "header": _HEADER, "noscript": _HIDDEN}
_BAD = re.compile(r"(?:^|[\s_-])(?:nav\w*|menu\w*|foot\w*|head(?:er)?|masthead|banner|side\w*|ads?|advert\w*|sponsor\w*|promo\w*|cookie\w*|consent|notice\w*|popup|modal|overlay|share|social|related|recommend\w*|breadcrumb\w*|pagination|pager|subscribe|newsletter|login|signup|search|widget\w*|toolbar|copyright|legal|disclaimer|tags?|skip|alert|gdpr|cta|contentinfo|navigation|complementary)(?:$|[\s_-])", re.I)
_GOOD = re.compile(r"(?:^|[\s_-])(?:article\w*|content|main\w*|post|entry|story|body|text|blog|prose)(?:$|[\s_-])", re.I)
_REMARKS = re.compile(r"(?:^|[\s_-])(?:comments?\w*|replies|reply|disqus|respond|discussion|reader\w*|responses)(?:$|[\s_-])", re.I)
_LEGAL = ("©", "(c)", "copyright", "all rights", "cookie", "privacy", "subscribe", "sign up", "login", "log in", "advert", "sponsored", "terms of")
_NONE = re.compile(r"display\s*:\s*none", re.I)


class Node:
    """An open or closed element, with the way up from it."""

    __slots__ = ("depth", "flags", "parent", "tag")

    def __init__(self, tag: str, flags: int, parent: Node | None) -> None:
        self.tag, self.flags, self.parent = tag, flags, parent
        self.depth = parent.depth + 1 if parent else 0


@dataclass
class Block:
    text: str
    tag: str
    flags: int
    linked: int
    node: Node

    @property
    def holder(self) -> Node:
        """The element that holds this block and its siblings."""
        return self.node.parent if self.node.parent and self.tag in _LEAVES else self.node


def _marks(tag: str, attributes: str, flags: int) -> int:
    """The flags of an element inside one with these flags."""
    flags |= _TAG_FLAGS.get(tag, 0)
    if not attributes or tag in ("body", "html"):
        return flags
    for a in _ATTR.finditer(attributes):
        key, value = a.group(1).lower(), a.group(2) or a.group(3) or a.group(4) or ""
        if key in ("class", "id", "role"):
            good = _GOOD.search(value)
            if good:
                flags |= _GOODNAME
            if _BAD.search(value):  # sections hold subject matter, so their names say less
                flags |= _WEAKNAME if good or tag in ("section", "article", "main") else _BADNAME
            if _REMARKS.search(value):
                flags |= _REMARK
        elif key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and _NONE.search(value)):
            flags |= _HIDDEN
    return flags


def blocks(html: str) -> list[Block]:
    """The blocks of text of a page in order; broken and cut-off markup is read as far as it goes."""
    out: list[Block] = []
    stack = [Node("", 0, None)]
    opened: defaultdict[str, list[int]] = defaultdict(list)  # of each kind, where its open elements stand on the stack
    parts: list[str] = []
    linked = links = 0
    pos, size = 0, len(html)

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(text, stack[-1].tag, stack[-1].flags, linked, stack[-1]))
        parts, linked = [], 0

    def pop(to: int) -> None:
        for node in reversed(stack[to:]):
            opened[node.tag].pop()
        del stack[to:]

    def say(s: str) -> None:
        nonlocal linked
        parts.append(s)
        if links:
            linked += len(s.strip())

    while pos < size:
        at = html.find("<", pos)
        text = html[pos : at if at >= 0 else size]
        if text:
            say(unescape(text) if "&" in text else text)
        if at < 0:
            break
        m = _TOKEN.match(html, at)
        if not m:
            say("<")
            pos = at + 1
            continue
        pos = m.end()
        tag = m.group(2)
        if not tag:
            continue
        tag = tag.lower()
        if pos == size and html[-1] != ">":
            break  # the page ends within a tag
        if m.group(1):
            if tag == "a":
                links = max(0, links - 1)
            elif tag in _BLOCK and opened[tag]:
                flush()
                links = 0
                pop(opened[tag][-1])
        elif tag in _RAW:
            if not (m.group(3).endswith("/") and tag == "title"):
                end = re.compile(f"</{tag}(?=[\\s/>])[^>]*>?", re.I).search(html, pos)
                pos = end.end() if end else size
            parts.append(" ")
        elif tag == "br":
            parts.append("\n")
        elif tag == "a":
            links += 1
        elif tag not in _BLOCK:
            if tag in ("img", "input"):
                parts.append(" ")
        else:
            flush()
            if tag in _VOID:
                continue
            if tag in _ENDS_P and stack[-1].tag == "p":
                pop(len(stack) - 1)
            kinds, scope = _CLOSES.get(tag, ((), ()))
            if any(opened[k] for k in kinds):
                at, edge = (max((opened[k][-1] for k in among if opened[k]), default=0) for among in (kinds, scope))
                if at > edge:
                    pop(at)
            elif tag in _HEADINGS and stack[-1].tag in _HEADINGS:
                pop(len(stack) - 1)
            links = 0
            stack.append(Node(tag, _marks(tag, m.group(3), stack[-1].flags), stack[-1]))
            opened[tag].append(len(stack) - 1)
            if tag == "xmp":  # its content is text as it stands
                end = re.compile(r"</xmp(?=[\s/>])[^>]*>?", re.I).search(html, pos)
                say(html[pos : end.start() if end else size])
                pos = end.start() if end else size
    flush()
    return out


def features(b: Block, place: float, marked: bool = False) -> list[float]:
    """What the classifier sees of a block; place: its part of the way through the page; marked: the page has an article."""
    n = len(b.text)
    w = b.text.count(" ") + 1
    has = lambda flag: bool(b.flags & flag)
    inside = has(_MAIN | _GOODNAME)
    return [
        1.0, float(np.log1p(w)) / 5, min(1.0, b.linked / n), float(has(_BOILER)), float(has(_MAIN)), float(has(_BADNAME)), float(has(_GOODNAME)), float(has(_REMARK)), float(has(_CONTROL)),
        float(has(_HEADER) and not inside), float(b.tag in _HEADINGS), float(b.tag == "p"), float(b.tag == "li"), float(b.text[-1] in ".!?…\"”»"), float(w < 5), min(1.0, 10 * sum(map(b.text.lower().count, _LEGAL)) / w), float(place > 0.9 and not inside),
        float(has(_WEAKNAME) and not inside), float(has(_HIDDEN) and not inside), float(marked and not inside), float(has(_BOILER) and inside),
        float(b.tag in _CELLS), float(b.tag in _CAPTIONS), float(b.tag == "pre"), min(1.0, b.linked / n) * (inside and not has(_BOILER | _BADNAME | _REMARK)), float(w < 5 and inside and not has(_BOILER | _BADNAME)),
    ]


# ---- generated pages, to fit the classifier


def _prose(r: random.Random, n: int) -> str:
    out = []
    while n > 0:
        k = min(n, r.randint(4, 18))
        s = " ".join("".join(r.choice("abcdefghiklmnoprstuvw") for _ in range(r.randint(2, 9))) for _ in range(k))
        out.append(s.capitalize() + r.choice("...?!"))
        n -= k
    return " ".join(out)


#: Names that say nothing, names of boilerplate of any length inside articles, and names that mislead: what generated
#: pages call their parts.
_PLAIN_NAMES = ("box", "c-12", "panel", "wrap", "row", "inner", "col-3", "zone", "kasten", "bloc", "caja", "u7")
_NAMED = ("ad", "advert", "promo", "sponsored", "newsletter", "cookie-notice", "related", "share")
_MISLEADING = ("notice-board", "search", "side-effects", "menu-of-the-day", "tags", "legal", "header-files", "related-work", "social", "alerts", "footnotes")


def _page(r: random.Random) -> tuple[str, set[str]]:
    """A page and the texts of its content blocks."""
    good: set[str] = set()

    def keep(s: str) -> str:
        good.add(s)
        return s

    word = lambda k: _prose(r, k).rstrip(".?!")
    name = lambda known: known if r.random() < 0.67 else r.choice(_PLAIN_NAMES)
    menu = lambda: "<ul>" + "".join(f'<li><a href="/{k}">{word(r.randint(1, 3))}</a></li>' for k in range(r.randint(3, 8))) + "</ul>"
    wrap = lambda tag, known, s: f"<{tag}>{s}</{tag}>" if r.random() < 0.5 and tag != "div" else f'<div class="{name(known)}">{s}</div>'
    head = r.choice(("", wrap("header", "header", f"<h2>{word(3)}</h2><p>{word(6)}</p>"))) + r.choice(("", wrap("nav", "main-nav", menu()), wrap("nav", "menu", menu())))
    notices = ("", f'<div class="{name("cookie-notice")}">We use cookies. {_prose(r, r.randint(5, 25))} <button>{word(1)}</button></div>', f'<div class="ad">{_prose(r, r.randint(3, 20))}</div>', f'<div id="{name("advert")}">{_prose(r, 8)}</div>', f'<section class="notice"><p>{_prose(r, 14)}</p></section>', f'<div class="{name("popup")}" hidden>{_prose(r, 12)}</div>', f"<noscript>{_prose(r, 8)}</noscript>")
    side = r.choice(("", wrap("aside", "sidebar", f"<h3>{word(2)}</h3>{menu()}<p>{_prose(r, r.randint(5, 30))}</p>")))
    body = f"<h1>{keep(word(r.randint(3, 9)))}</h1>"
    if r.random() < 0.2:
        body = f"<header>{body}</header>"
    for _ in range(r.randint(2, 12)):
        kind = r.random()
        if kind < 0.62:
            body += f"<p>{keep(_prose(r, r.choice((1, 3, 8, 20, 40, 90))))}</p>"
        elif kind < 0.72:
            body += f"<h2>{keep(word(r.randint(1, 6)))}</h2>"
        elif kind < 0.8:
            body += "<ul>" + "".join(f"<li>{keep(_prose(r, r.randint(2, 15)))}</li>" for _ in range(r.randint(2, 4))) + "</ul>"
        elif kind < 0.85:
            body += f"<blockquote>{keep(_prose(r, 15))}</blockquote>"
        elif kind < 0.9:  # a part of the article, whatever its name
            mark = r.choice(("class", "id")) + f'="{r.choice(_MISLEADING + _PLAIN_NAMES)}"'
            body += f"<section {mark}{r.choice(('', '', ' hidden'))}>" + r.choice(("", f"<h2>{keep(word(3))}</h2>")) + "".join(f"<p>{keep(_prose(r, r.randint(6, 40)))}</p>" for _ in range(r.randint(1, 3))) + "</section>"
        elif kind < 0.94:
            body += _special(r, lambda k: keep(word(k)))
        else:
            body += r.choice((f'<div class="ad">{_prose(r, r.randint(3, 20))}</div>', f'<section class="comments"><p>{_prose(r, r.randint(3, 40))}</p></section>', f"<aside><p>{_prose(r, 10)}</p></aside>", f'<div class="share"><a href="#">{word(1)}</a></div>', *(f'<div class="{r.choice(_NAMED)}">' + "".join(f"<p>{_prose(r, r.randint(3, 60))}</p>" for _ in range(r.randint(1, 2))) + "</div>" for _ in range(4)), f"<form><p>{_prose(r, r.randint(4, 20))}</p><input><button>{word(1)}</button></form>", f'<div class="{r.choice(("related", "tags", "social"))}">{r.choice(("", f"<h3>{word(2)}</h3>"))}{menu()}</div>', f'<nav class="{name("toc-nav")}">{menu()}</nav>', f'<aside>{_special(r, word)}</aside>'))
    article = r.choice((f"<article>{body}</article>", f"<main><article>{body}</article></main>", f'<div class="content">{body}</div>', f'<div id="post">{body}</div>', f"<main>{body}</main>", f"<div>{body}</div>"))
    remarks = "" if r.random() < 0.5 else '<section class="comments">' + "".join(f"<p>{_prose(r, r.randint(3, 50))}</p>" for _ in range(r.randint(1, 5))) + "</section>"
    form = r.choice(("", f"<form><label>{word(2)}</label><input><p>{_prose(r, r.randint(3, 12))}</p><button>{word(1)}</button></form>"))
    foot = r.choice(("", wrap("footer", "footer", f"&copy; {word(2)} <p>{_prose(r, r.randint(3, 20))}</p>"), wrap("footer", "site-footer", menu() + f"© {word(2)}")))
    return f"<html><head><title>{word(3)}</title></head><body>{head}{r.choice(notices)}{article}{r.choice((side + remarks, remarks + side))}{form}{foot}</body></html>", good


def _special(r: random.Random, say: Callable[[int], str]) -> str:
    """A table, a figure, code, a list of links or of terms, made of what say gives for a number of words."""
    few = lambda most: say(r.randint(1, most))
    kind = r.randrange(5)
    if kind == 0:
        rows = [[few(3) for _ in range(r.randint(2, 4))] for _ in range(r.randint(2, 6))]
        head = "<tr>" + "".join(f"<th>{c}</th>" for c in rows[0]) + "</tr>"
        return f"<table>{r.choice(('', f'<caption>{few(8)}</caption>'))}{head}" + "".join("<tr>" + "".join(f"<td>{c}</td>" for c in row) + "</tr>" for row in rows[1:]) + "</table>"
    if kind == 1:
        return f'<figure><img src="/{r.randrange(99)}.png"><figcaption>{say(r.randint(2, 18))}</figcaption></figure>'
    if kind == 2:
        return f"<pre><code>{say(r.randint(1, 30))}</code></pre>"
    if kind == 3:
        return "<ul>" + "".join(f'<li><a href="/{k}">{few(3)}</a></li>' for k in range(r.randint(2, 8))) + "</ul>"
    return "<dl>" + "".join(f"<dt>{few(3)}</dt><dd>{say(r.randint(1, 12))}</dd>" for _ in range(r.randint(1, 4))) + "</dl>"


@dataclass
class Model:
    weights: np.ndarray
    smooth: float = 0.6
    near: float = 0.4

    def label(self, found: list[Block]) -> list[bool]:
        """Content or not, for each block, at the least sum of classifier and smoothness costs."""
        if not found:
            return []
        z = np.clip(np.array(_seen(found)) @ self.weights, -12, 12)
        edges: list[tuple[int, int, float]] = []
        last: dict[int, int] = {}
        for k, b in enumerate(found):
            if k:
                edges.append((k - 1, k, self.smooth / (1 + _apart(found[k - 1].node, b.node))))
            holder = id(b.holder)
            if (other := last.get(holder)) is not None and other < k - 1:
                edges.append((other, k, self.near))
            last[holder] = k
        return cut(z.tolist(), edges)


def _seen(found: list[Block]) -> list[list[float]]:
    """The features of a page's blocks."""
    marked = any(b.flags & _MAIN for b in found)
    return [features(b, k / len(found), marked) for k, b in enumerate(found)]


def _apart(a: Node, b: Node) -> int:
    """Steps of the way between two places in the tree, beyond those of siblings. Blocks that follow each other
    are all together no further apart than a walk around the tree."""
    steps = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return max(0, steps - 2) ** 2


def cut(gain: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels that minimise sum(max(0, -gain) of the true, max(0, gain) of the false) + weights of cut edges."""
    n = len(gain)
    u = list(gain)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for i, j, w in edges:
        near[i][j] = near[i].get(j, 0.0) + w
        near[j][i] = near[j].get(i, 0.0) + w
    label: list[bool | None] = [None] * n
    work = deque(range(n))
    while work:  # a block that outweighs all its edges keeps its own label in some optimum
        i = work.popleft()
        if label[i] is None and abs(u[i]) >= sum(near[i].values()):
            label[i] = u[i] > 0
            for j, w in near[i].items():
                u[j] += w if label[i] else -w
                del near[j][i]
                if label[j] is None:
                    work.append(j)
            near[i] = {}
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        for i, side in zip(rest, _max_flow(rest, u, near), strict=True):
            label[i] = side
    return [bool(x) for x in label]


def _max_flow(nodes: list[int], u: list[float], near: list[dict[int, float]]) -> list[bool]:
    """Source side of a minimum cut, by blocking flows over shortest paths; the source is content."""
    place = {v: k for k, v in enumerate(nodes)}
    s, t = len(nodes), len(nodes) + 1
    head: list[list[int]] = [[] for _ in range(len(nodes) + 2)]  # numbers of arcs; arc ^ 1 is the way back
    to: list[int] = []
    room: list[float] = []

    def join(a: int, b: int, there: float, back: float) -> None:
        head[a].append(len(to))
        head[b].append(len(to) + 1)
        to.extend((b, a))
        room.extend((there, back))

    for v, k in place.items():
        if u[v] > 0:
            join(s, k, u[v], 0.0)
        elif u[v] < 0:
            join(k, t, -u[v], 0.0)
        for w, c in near[v].items():
            if place[w] > k:
                join(k, place[w], c, c)
    while True:
        level = [-1] * len(head)
        level[s] = 0
        line = deque([s])
        while line:
            v = line.popleft()
            for e in head[v]:
                if room[e] > 1e-12 and level[to[e]] < 0:
                    level[to[e]] = level[v] + 1
                    line.append(to[e])
        if level[t] < 0:
            return [x >= 0 for x in level[: len(nodes)]]
        following = [0] * len(head)
        way: list[int] = []
        v = s
        while True:
            if v == t:
                flow = min(room[e] for e in way)
                full = len(way)
                for k in range(len(way) - 1, -1, -1):
                    room[way[k]] -= flow
                    room[way[k] ^ 1] += flow
                    if room[way[k]] <= 1e-12:
                        full = k
                v = to[way[full] ^ 1]
                del way[full:]
                continue
            while following[v] < len(head[v]):
                e = head[v][following[v]]
                if room[e] > 1e-12 and level[to[e]] == level[v] + 1:
                    break
                following[v] += 1
            if following[v] < len(head[v]):
                way.append(e)
                v = to[e]
            elif way:
                v = to[way.pop() ^ 1]
                following[v] += 1
            else:
                break


@cache
def train(pages: int = 400, seed: int = 23) -> Model:
    """A ridge-penalised logistic classifier of the blocks of generated pages, fitted once a process."""
    r = random.Random(seed)
    xs, ys = [], []
    for _ in range(pages):
        html, good = _page(r)
        found = blocks(html)
        xs += _seen(found)
        ys += [b.text in good for b in found]
    x, y = np.array(xs), np.array(ys, float)
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.3 * np.eye(len(w)), x.T @ (p - y) + 0.3 * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return Model(w)


def main_text(html: str | None, model: Model) -> str:
    """The content blocks of a page, one a line."""
    found = blocks(html or "")
    return "\n".join(b.text for b, good in zip(found, model.label(found), strict=True) if good)


def extract(pages: DataFrame, model: Model, html: str = "html") -> DataFrame:
    """pages with main_text added, in place of a column of that name.

    Null and empty pages, and pages without content, have the empty text. Equal pages get equal texts, whatever
    their ids; of labellings with equal cost the one that the flow finds first is taken, always the same. An
    empty table gives no rows.
    """
    pages = pages.drop("main_text")
    shared = pages.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*pages.schema.fields, T.StructField("main_text", T.StringType())])
    column, names = pages.columns.index(html), schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            out = [main_text(h, model) for h in batch.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names)

    return pages.mapInArrow(run, schema)
