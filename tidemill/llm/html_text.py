"""HTML extraction by scoring the tree.

A paragraph gives its parent 1 point, one for each comma and up to 3 for its length, and its grandparent half of that. Containers start from points for their
tag and for what their class and id say, and their score is discounted by the share of their text that is in links. The best container is kept with those
siblings that score at least a fifth of it, or are paragraphs that read like prose. Whole pages are walked, without recursion, in time that grows with the page alone: lengths and commas are
summed from the leaves up, and open elements are counted by name, so that no tag walks past elements that stay open.

Defined results: null html gives null text and score; pages without a scored container give the text outside navigation, headers and footers, with score 0;
empty pages give ''; of equal scores the first container in the page wins; unclosed and stray tags are repaired as browsers do for p, li, td, tr, dd, dt and option;
repeated rows give the same text; other columns are kept by extracted(); an empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|textarea|title|iframe)\b[^>]*(?:>.*?(?:</\1\s*>|\Z)|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>", re.S | re.I)
_SAID = re.compile(r"\b(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_BAD = re.compile(r"\bads?\b|advert|banner|breadcrumb|comment|cookie|footer|masthead|menu|\bnav|pager|popup|promo|related|share|sidebar|social|sponsor|subscribe|widget", re.I)
_GOOD = re.compile(r"article|\bbody\b|content|entry|main|\bpage\b|post|story|text", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_SKIP = frozenset("nav header footer aside form button select menu".split())
_BLOCK = frozenset("address article aside blockquote body center dd details div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table tbody td tfoot th thead tr ul".split())
_CLOSES = {t: frozenset(("p",)) for t in _BLOCK - {"html", "body", "li", "dd", "dt", "td", "th", "tr", "tbody", "thead", "tfoot"}}
_CLOSES |= {"li": frozenset(("p", "li")), "dd": frozenset(("p", "dd", "dt")), "dt": frozenset(("p", "dd", "dt")), "td": frozenset(("p", "td", "th")), "th": frozenset(("p", "td", "th")), "tr": frozenset(("p", "td", "th", "tr")), "option": frozenset(("option",))}
_FENCE = frozenset("ul ol dl table div article section main body html blockquote td th".split())
_TAG_POINTS = {"article": 10, "main": 8, "section": 3, "div": 5, "pre": 3, "td": 3, "blockquote": 3, "ul": -3, "ol": -3, "dl": -3, "form": -5, "nav": -25, "aside": -10, "footer": -25, "header": -10, "h1": -5, "h2": -5, "h3": -5, "th": -5}
_PARAGRAPH = frozenset(("p", "pre", "td", "blockquote"))
_SPACE = re.compile(r"\s+")


class Node:
    """An element. stretch counts the open elements by name from the nearest fence on; fence is that fence. size, before and after describe the text below as if all space were collapsed."""

    __slots__ = ("tag", "parent", "kids", "said", "order", "fence", "stretch", "chars", "linked", "size", "before", "after", "commas")

    def __init__(self, tag: str, parent: "Node | None", said: str, order: int):
        self.tag, self.parent, self.kids, self.said, self.order = tag, parent, [], said, order
        self.chars = self.linked = self.size = self.commas = 0
        self.before = self.after = False
        if parent is None or tag in _FENCE:
            self.fence, self.stretch = self, {}
        else:
            self.fence, self.stretch = parent.fence, parent.stretch


def tree(page: str) -> tuple[Node, list[Node]]:
    """The root and all nodes in page order; text is kept in kids as str."""
    root = at = Node("#root", None, "", 0)
    nodes, last, open_ = [root], 0, {}

    def leave(to: Node) -> None:
        nonlocal at
        while at is not to:
            open_[at.tag] -= 1
            if at.fence is not at:
                at.stretch[at.tag] -= 1
            at = at.parent

    for m in _TOKEN.finditer(page):
        if m.start() > last:
            at.kids.append(page[last : m.start()])
        last = m.end()
        tag = m[3]
        if not tag:
            continue
        tag = tag.lower()
        if m[2]:
            if open_.get(tag):
                up = at
                while up.tag != tag:
                    up = up.parent
                leave(up.parent)
            continue
        if ends := _CLOSES.get(tag):
            up = at
            while up.parent is not None:
                if up.tag in ends:
                    leave(up.parent)
                    up = at
                elif up.tag in _FENCE:
                    break
                elif any(up.stretch.get(t) for t in ends):
                    up = up.parent
                elif up.fence.tag in ends:
                    up = up.fence
                else:
                    break
        if tag == "br":
            at.kids.append("\n")
            continue
        said = m[4]
        node = Node(tag, at, " ".join(_SAID.findall(said)) if "=" in said else "", len(nodes))
        at.kids.append(node)
        nodes.append(node)
        if tag not in _VOID and not said.endswith("/"):
            at = node
            open_[tag] = open_.get(tag, 0) + 1
            if node.fence is not node:
                node.stretch[tag] = node.stretch.get(tag, 0) + 1
    if last < len(page):
        at.kids.append(page[last:])
    return root, nodes


def _measure(nodes: list[Node]) -> None:
    """From the leaves up: characters of text and of text in links, the length of the text with space collapsed and stripped, and commas."""
    for n in reversed(nodes):
        chars = linked = size = commas = 0
        before, after = False, False  # whether space comes before the text, or at all, and after it
        for k in n.kids:
            if isinstance(k, str):
                core = _SPACE.sub(" ", k)
                blank = core == " "
                a, b = core[0] == " ", core[-1] == " "
                own = 0 if blank else len(core) - a - b
                chars += 0 if blank else len(core)
                commas += k.count(",")
            else:
                a, b, own = k.before, k.after, k.size
                chars += k.chars
                linked += k.linked
                commas += k.commas
            if not own:
                after = after or a
                before = before or (a and not size)
            elif size:
                size += own + (after or a)
                after = b
            else:
                size, before, after = own, before or a, b
        n.chars, n.size, n.commas, n.before, n.after = chars, size, commas, before, after
        n.linked = chars if n.tag == "a" else linked


def _points(n: Node) -> float:
    s = _TAG_POINTS.get(n.tag, 0)
    if n.said:
        s += 25 * bool(_GOOD.search(n.said)) - 25 * bool(_BAD.search(n.said))
    return s


def _own(n: Node) -> str:
    """The text below a node, without block breaks."""
    out, stack = [], [n]
    while stack:
        k = stack.pop()
        if isinstance(k, str):
            out.append(k)
        else:
            stack.extend(reversed(k.kids))
    return "".join(out)


def scores(nodes: list[Node]) -> dict[int, float]:
    """The discounted score of each container, by its place in the page."""
    got: dict[int, float] = {}
    for n in nodes:
        if n.tag not in _PARAGRAPH and not (n.tag == "div" and not any(isinstance(k, Node) and k.tag in _BLOCK for k in n.kids)):
            continue
        if n.size < 25:
            continue
        gain = 1 + n.commas + min(n.size // 100, 3)
        up, part = n.parent, 1.0
        for _ in range(2):
            if up is None or up.parent is None:
                break
            if up.order not in got:
                got[up.order] = _points(up)
            got[up.order] += gain * part
            up, part = up.parent, part / 2
    return {k: v * (1 - nodes[k].linked / max(nodes[k].chars, 1)) for k, v in got.items()}


def _render(parts: list, drop: frozenset = frozenset()) -> str:
    """Text of nodes, a line for each block."""
    out, stack = [], list(reversed(parts))
    while stack:
        k = stack.pop()
        if isinstance(k, str):
            out.append(k if k == "\n" else _SPACE.sub(" ", k))
        elif k.tag not in drop:
            block = k.tag in _BLOCK
            if block:
                out.append("\n")
                stack.append("\n")
            stack.extend(reversed(k.kids))
    text = "".join(out)
    if "&" in text:
        text = entities.unescape(text)
    return "\n".join(line for line in (" ".join(x.split()) for x in text.split("\n")) if line)


def extract(page: str | None) -> tuple[str | None, float | None]:
    """(text, score) of a page."""
    if page is None:
        return None, None
    root, nodes = tree(page)
    _measure(nodes)
    got = scores(nodes)
    if not got:
        return _render([root], _SKIP), 0.0
    best = min(got, key=lambda k: (-got[k], k))
    top, score = nodes[best], got[best]
    least = max(10.0, score * 0.2)
    kept = []
    for k in top.parent.kids if top.parent is not None else [top]:
        if k is top:
            kept.append(k)
        elif isinstance(k, Node):
            if got.get(k.order, float("-inf")) >= least:
                kept.append(k)
            elif k.tag == "p":
                share = k.linked / max(k.chars, 1)
                if k.chars > 80 and share < 0.25 or 0 < k.chars <= 80 and not share and _own(k).rstrip().endswith("."):
                    kept.append(k)
    return _render(kept, _SKIP), round(score, 6)


def extracted(column: Column) -> Column:
    """A struct (text, score) for a column of html."""

    @F.arrow_udf("text string, score double")
    def run(pages: pa.Array) -> pa.Array:
        got = [extract(p.as_py()) for p in pages]
        return pa.StructArray.from_arrays([pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], ["text", "score"])

    return run(column.cast("string"))
