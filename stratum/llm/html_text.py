"""Main text of web pages by minimum-cut labelling.

A page is scanned once into text blocks, each with its place in the DOM. A linear
classifier (`page_model`: fitted on generated pages of known content) gives each
block the log odds of being content, from its text, its tag, its ancestors' tags
and names. The log odds become the terminal capacities of a
flow network (the cost of calling the block boilerplate, or content); neighbours
in page order and blocks of one parent get smoothness edges, whose capacities
depend on how near the two are in the DOM and are fitted together with the
classifier, on the same scale. The minimum cut is the labelling of least total cost. Blocks whose own cost
outweighs all their edges have the same label in every minimum cut and are folded
into their neighbours first; max-flow decides the rest.

Every page is handled on its own in one narrow pass, in time linear in its length
but for the flow.

Defined results: a null or empty page has an empty text; truncated or malformed
pages are read as far as they go (missing end tags are implied); very long pages
are read whole; blocks of equal cost either way are boilerplate; rows that repeat,
or have a null id, each get their own row; an empty table gives an empty result;
extra columns, whatever their names, are not read.
"""

from __future__ import annotations

import html
import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))"
    r"|<(script|style|textarea|title|iframe)(?=[\s/>])[^>]*+>.*?(?:</\1(?=[\s/>])[^>]*+>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:_.-]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:_.-]*+)([^>]*+)(?:>|\Z)"
    r"|<[!?/][^>]*+(?:>|\Z)",
    re.S | re.I,
)
_HINT = re.compile(r"""\b(class|id|role|style|aria-hidden|hidden|itemprop)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

# HTML element names. All others are inline.
BLOCK = frozenset(
    "address article aside blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {
    "li": frozenset(["li", "p"]),
    "dt": frozenset(["dt", "dd", "p"]),
    "dd": frozenset(["dt", "dd", "p"]),
    "tr": frozenset(["tr", "td", "th", "p"]),
    "td": frozenset(["td", "th", "p"]),
    "th": frozenset(["td", "th", "p"]),
}
ENDS_P = frozenset("address article aside blockquote center details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SCOPE = frozenset("article aside body div footer form header html main nav ol section table td th ul dl blockquote".split())
#: Their text is not shown, or is not running text.
MUTED = frozenset("svg button select canvas audio video noscript template datalist".split())
#: What begins outside of a muted element that was not closed.
BREAKS = frozenset("p h1 h2 h3 h4 h5 h6 article section main table ul ol blockquote".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
STRUCTURE = frozenset("article main nav header footer aside form menu dialog section ul ol table dl figure blockquote fieldset details address pre".split())


class Element:
    __slots__ = ("tag", "up", "names", "hidden", "words", "own", "marks", "score")

    def __init__(self, tag: str, up: Element | None, attrs: str = ""):
        self.tag, self.up = tag, up
        self.names: tuple[str, ...] = ()
        self.hidden = False
        self.words = self.own = self.marks = 0  # words in it, words of its direct blocks, inherited marks
        self.score = 0.0
        if attrs and tag not in ("html", "body"):
            names = []
            for name, *values in _HINT.findall(attrs):
                name, value = name.lower(), next((v for v in values if v), "")
                if name in ("class", "id", "role", "itemprop"):
                    names += {w.lower() for w in _PART.findall(value)}
                elif (name == "hidden" and value.lower() != "false") or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and _UNSEEN.search(value)):
                    self.hidden = True
            self.names = tuple(sorted(set(names)))


@dataclass
class Block:
    text: str
    linked: int  # characters in links
    element: Element
    words: int = 0
    score: float = 0.0


def parse(page: str) -> tuple[list[Block], list[Element]]:
    """Text blocks in page order, and all elements, each after its parent."""
    found: list[Block] = []
    root = Element("#root", None)
    stack, every = [root], [root]
    open_: Counter[str] = Counter()
    parts: list[str] = []
    linked = anchors = 0
    mute: str | None = None
    none_left: dict[str, bool] = {}
    low = page.lower()
    close_at: dict[str, int] = {}

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                found.append(Block(text, linked, stack[-1], text.count(" ") + 1))
            parts, linked = [], 0

    def text(raw: str) -> None:
        nonlocal linked
        if raw and mute is None:
            parts.append(raw)
            if anchors:
                linked += len(raw)

    def pop(k: int) -> None:
        for e in stack[k:]:
            open_[e.tag] -= 1
        del stack[k:]

    def closed_later(tag: str, at: int) -> bool:
        """Whether an end tag follows; each page is searched once per tag."""
        if none_left.get(tag):
            return False
        if close_at.get(tag, -1) < at:
            close_at[tag] = low.find(f"</{tag}", at)
            if close_at[tag] < 0:
                none_left[tag] = True
                return False
        return True

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            text(page[at : m.start()])
        at = m.end()
        tag = m[3] or m[6]
        if tag is None:
            if m[1]:
                text(" ")
            continue
        tag = tag.lower()
        closing, attrs = (m[2], m[4]) if m[3] else (m[5], m[7])
        if mute is not None:
            if tag == mute and closing:
                mute = None
                continue
            if closing or tag not in BREAKS or mute in ("noscript", "template"):
                continue
            mute = None  # it was left open
        if tag in MUTED:
            if not closing and not (tag == "svg" and attrs.rstrip().endswith("/")) and (tag == "select" or closed_later(tag, at)):
                mute = tag
            continue
        if tag not in BLOCK:
            if tag == "br":
                text(" ")
            elif tag == "a":
                anchors = 0 if closing else 1
            continue
        flush()
        if closing:
            if open_[tag] > 0:
                k = len(stack) - 1
                while stack[k].tag != tag:
                    k -= 1
                pop(k)
            anchors = 0
            continue
        ends = CLOSES.get(tag, frozenset()) | ({"p"} if tag in ENDS_P else frozenset())
        if any(open_[x] > 0 for x in ends):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in ends:
                    pop(k)
                elif stack[k].tag in SCOPE:
                    break
        if tag not in VOID:
            stack.append(Element(tag, stack[-1], attrs))
            every.append(stack[-1])
            open_[tag] += 1
    if at < len(page):
        text(page[at:])
    flush()
    for b in found:
        b.element.words += b.words
        b.element.own += b.words
    for e in reversed(every):
        if e.up is not None:
            e.up.words += e.words
            if e.tag in ("p", "blockquote", "pre") or e.tag in HEADINGS:
                e.up.own += e.own
    return found, every


def marks(e: Element, total: int) -> list[str]:
    """What an element says of all text in it; said by one with most of the page's words, it means something else."""
    size = "most" if 2 * e.words >= total else "part"
    out = [f"name {w} {size}" for w in e.names]
    if e.tag in STRUCTURE:
        out.append(f"tag {e.tag} {size}")
    if e.hidden:
        out.append("hidden")
    return out


def _step(x: float, steps: tuple[float, ...]) -> int:
    return sum(x >= s for s in steps)


def own_marks(found: list[Block], total: int) -> list[list[str]]:
    """What each block says of itself, by its text, its tag and its parent; its neighbours speak through the edges."""
    about = []
    begun, any_h1 = 0, any(b.element.tag == "h1" for b in found)
    for b in found:
        e = b.element
        t = "h" if e.tag in HEADINGS else e.tag if e.tag in ("p", "li", "td", "th", "dt", "dd", "pre", "blockquote", "figcaption", "legend", "caption") else "div"
        links = _step(b.linked / len(b.text), (0.01, 0.34, 0.75))
        words = min(b.words.bit_length(), 7)
        stops = b.text[-1] in ".!?…\"”»:" or ". " in b.text
        begun |= e.tag == "h1"
        parent = e.up if e.up is not None else e
        about.append([
            "bias", f"kind {t}", f"links {links}", f"words {words}", f"stops {int(stops)}", f"kind {t} stops {int(stops)} links {links}",
            f"h1 {'seen' if begun else 'to come' if any_h1 else 'none'}",
            f"running {_step(max(parent.own, e.own) / max(total, 1), (0.02, 0.1, 0.25, 0.5))}",
            f"sign {b.text[0] == '©' or '©' in b.text}",
        ])
    return about


@dataclass(frozen=True)
class Model:
    """Weights of marks, and capacities of the kinds of smoothness edges, all in log odds."""

    weight: dict[str, float] = field(default_factory=dict)
    edge: dict[str, float] = field(default_factory=dict)


def blocks(page: str, model: Model) -> list[Block]:
    """Text blocks in page order with their log odds of being content."""
    found, every = parse(page)
    total = every[0].words
    number: dict[str, int] = {}
    for e in every:
        if e.up is not None:
            e.marks, e.score = e.up.marks, e.up.score
        for x in marks(e, total):
            w = model.weight.get(x)
            if w:
                bit = 1 << number.setdefault(x, len(number))
                if not e.marks & bit:
                    e.marks |= bit
                    e.score += w
    for b, about in zip(found, own_marks(found, total), strict=True):
        b.score = b.element.score + sum(model.weight.get(x, 0.0) for x in about)
    return found


def relation(a: Element, b: Element, most: int = 4) -> str:
    """How near two elements are in the DOM: steps to their common ancestor (up to `most` each), the borders of parts crossed on the way, and whether the outermost of these are alike."""
    up: dict[int, tuple[int, int, Element | None]] = {}
    x, walls, under = a, 0, None
    for k in range(most + 1):
        up.setdefault(id(x), (k, walls, under))
        if x.up is None:
            break
        walls += bool(x.names or x.hidden or x.tag in STRUCTURE)
        x, under = x.up, x
    x, walls, under = b, 0, None
    for k in range(most + 1):
        if id(x) in up:
            steps, crossed, other = up[id(x)]
            alike = "in" if under is None or other is None else "alike" if (under.tag, under.names) == (other.tag, other.names) else "unlike"
            return f"near {min(steps, 2)} {min(k, 2)} walls {min(walls + crossed, 3)} {alike}"
        if x.up is None:
            break
        walls += bool(x.names or x.hidden or x.tag in STRUCTURE)
        x, under = x.up, x
    return "far"


def pairs(found: list[Block]) -> Iterator[tuple[int, int, str]]:
    """Edges: neighbours in page order, by their relation in the DOM, and each block with the next one of its parent that is not its neighbour."""
    last: dict[int, int] = {}
    for i, b in enumerate(found):
        if i:
            yield i - 1, i, relation(found[i - 1].element, b.element)
        parent = id(b.element.up)
        if (j := last.get(parent, i - 1)) < i - 1:
            yield j, i, f"siblings {found[j].element.tag == b.element.tag}"
        last[parent] = i


def edges(found: list[Block], model: Model) -> dict[tuple[int, int], float]:
    """Smoothness capacities."""
    return {(i, j): c for i, j, kind in pairs(found) if (c := model.edge.get(kind, 0.0)) > 0}


def min_cut(score: list[float], links: dict[tuple[int, int], float]) -> list[bool]:
    """Labels of least cost: a block of score s costs s as boilerplate or -s as content, and an edge its capacity if its ends differ."""
    n = len(score)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for (i, j), c in links.items():
        near[i][j] = near[i].get(j, 0.0) + c
        near[j][i] = near[j].get(i, 0.0) + c
    own = list(score)
    label: list[bool | None] = [None] * n
    queue = deque(range(n))
    while queue:
        i = queue.popleft()
        if label[i] is None and abs(own[i]) > sum(near[i].values()):
            label[i] = own[i] > 0
            for j, c in near[i].items():
                own[j] += c if label[i] else -c
                del near[j][i]
                if label[j] is None:
                    queue.append(j)
            near[i] = {}
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        content = max_flow({i: own[i] for i in rest}, {i: near[i] for i in rest})
        for i in rest:
            label[i] = i in content
    return [bool(x) for x in label]


def max_flow(own: dict[int, float], near: dict[int, dict[int, float]]) -> set[int]:
    """Source side of a minimum cut, by blocking flows; positive scores hang on the source, negative ones on the sink."""
    scale = 1 << 20
    source, sink = -1, -2
    cap: dict[int, dict[int, int]] = {source: {}, sink: {}}
    for i, links in near.items():
        cap.setdefault(i, {})
        for j, c in links.items():
            cap[i][j] = round(c * scale)
    for i, s in own.items():
        a, b = (source, i) if s > 0 else (i, sink)
        cap[a][b] = round(abs(s) * scale)
        cap[b].setdefault(a, 0)
    while True:
        level = {source: 0}
        queue = deque([source])
        while queue:
            u = queue.popleft()
            for v, c in cap[u].items():
                if c > 0 and v not in level:
                    level[v] = level[u] + 1
                    queue.append(v)
        if sink not in level:
            return {i for i in own if i in level}
        todo = {u: [v for v in cap[u] if level.get(v, -1) == level[u] + 1] for u in level}
        path = [source]
        while path:
            u = path[-1]
            if u == sink:
                push = min(cap[a][b] for a, b in zip(path, path[1:], strict=False))
                for a, b in zip(path, path[1:], strict=False):
                    cap[a][b] -= push
                    cap[b][a] = cap[b].get(a, 0) + push
                path = [source]
                continue
            while todo[u] and cap[u][todo[u][-1]] <= 0:
                todo[u].pop()
            if todo[u]:
                path.append(todo[u][-1])
            else:
                path.pop()
                if path:
                    todo[path[-1]].pop()


def labels(found: list[Block], model: Model) -> list[bool]:
    return min_cut([b.score for b in found], edges(found, model))


def main_text(page: str | None, model: Model) -> str:
    if not page:
        return ""
    found = blocks(page, model)
    return "\n\n".join(b.text for b, k in zip(found, labels(found, model), strict=True) if k)


def extract(pages: DataFrame, model: Model | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text and n_chars (code points). Without a model, the one of `page_model` is fitted."""
    if model is None:
        from .page_model import fitted

        model = fitted()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                out = [main_text(x.as_py(), model) for x in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    src = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return src.mapInArrow(run, "page_id long, url string, text string, n_chars long")
