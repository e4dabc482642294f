"""A small forgiving HTML tree builder: elements, their own text, and where blocks break."""

from __future__ import annotations

import re
from html import unescape

# fixed values: element sets of the HTML standard
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("script style textarea title xmp iframe noembed noframes noscript template head select button svg math object audio video canvas datalist".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
_IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"tr", "td", "th", "tbody", "thead", "tfoot"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot"}, {"table"}), "tfoot": ({"tr", "td", "th", "tbody", "thead"}, {"table"}), "option": ({"option"}, {"select"}),
    "optgroup": ({"option", "optgroup"}, {"select"}), "body": ({"head"}, {"html"}),
}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")


class Node:
    """A block. ``parts``: its own runs of text and its children, in page order."""

    __slots__ = ("attrs", "children", "inline_tags", "link_chars", "parent", "parts", "tag")

    def __init__(self, tag: str, attrs: str, parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node] = []
        self.parts: list = []
        self.link_chars = self.inline_tags = 0
        if parent is not None:
            parent.children.append(self)
            parent.parts.append(self)


def attributes(raw: str) -> dict[str, str]:
    return {k.lower(): unescape(a or b or c or "") for k, a, b, c in _ATTRIBUTE.findall(raw)} if raw else {}


def parse(html: str | None) -> Node:
    """The tree of blocks. Hidden elements leave nothing; inline elements belong to their block."""
    root = Node("#root", "", None)
    stack: list[tuple[str, Node]] = [("#root", root)]  # open elements, each with the block it lies in
    html = html or ""
    at, links = 0, 0

    def text(a: int, b: int) -> None:
        if b > a:
            block = stack[-1][1]
            raw = html[a:b]
            block.parts.append(raw)
            if links:
                block.link_chars += len(raw)

    def drop(depth: int) -> None:
        nonlocal links
        for tag, _ in stack[depth:]:
            links -= tag == "a"
        del stack[depth:]

    def find(tags, stop) -> int:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in tags:
                return i
            if stack[i][0] in stop:
                break
        return 0

    n = len(html)
    while at < n:
        m = _TOKEN.search(html, at)
        if m is None:
            text(at, n)
            break
        text(at, m.start())
        at = m.end()
        closing, tag, raw, end = m.group(1), m.group(2), m.group(3), m.group(4)
        if tag is None and m.group(6):
            closing, tag, raw, end = m.group(5), m.group(6), m.group(7), m.group(8)
        if tag is None or not end:  # a comment, a declaration, or a tag cut off by the end of the page
            continue
        tag = tag.lower()
        if closing:
            if tag == "p" and not find({"p"}, ()):
                continue
            if i := find({tag}, () if tag not in INLINE else CLOSES_P | {"td", "th", "li", "body"}):
                drop(i)
            continue
        if tag == "br":
            stack[-1][1].parts.append(" ")
            continue
        if tag in CLOSES_P and (i := find({"p"}, {"button", "table", "td", "th"})):
            drop(i)
        if tag in _IMPLIED and (i := find(*_IMPLIED[tag])):
            while i > 1 and stack[i - 1][0] in _IMPLIED[tag][0]:
                i -= 1
            drop(i)
        if tag in VOID or raw.endswith("/") and tag in ("path", "circle"):
            if tag == "hr":
                Node("hr", "", stack[-1][1])
            continue
        if tag in RAW:
            m = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(html, at)
            at = m.end() if m else n
            continue
        if tag in HIDDEN:
            at = _skip(html, at, tag)
            continue
        if tag in INLINE:
            stack[-1][1].inline_tags += 1
            links += tag == "a"
            stack.append((tag, stack[-1][1]))
        else:
            stack.append((tag, Node(tag, raw, stack[-1][1])))
    return root


def _skip(html: str, at: int, tag: str) -> int:
    """Behind the end of a hidden element; an unclosed head ends where the body begins."""
    depth = 1
    for m in re.compile(rf"<!--.*?(?:-->|\Z)|<(/?)({re.escape(tag)}|script|style|body)(?=[\s/>])([^>]*)>", re.I | re.S).finditer(html, at):
        if m.start() < at or not m.group(2):
            continue
        name = m.group(2).lower()
        if name == "body" and tag == "head":
            return m.start()
        if name in ("script", "style") and name != tag:
            if not m.group(1):
                end = re.compile(rf"</{name}(?=[\s/>])", re.I).search(html, m.end())
                at = end.start() if end else len(html)
            continue
        if name == tag:
            depth += -1 if m.group(1) else 0 if m.group(3).endswith("/") else 1
            if depth == 0:
                return m.end()
    return len(html) if tag != "head" else at


def own_texts(node: Node) -> list[str]:
    """The runs of text between a block's children, decoded and with single spaces, empty ones left out."""
    out, run = [], []
    for p in [*node.parts, None]:
        if isinstance(p, str):
            run.append(p)
        else:
            if t := " ".join(unescape("".join(run)).split()):
                out.append(t)
            run = []
    return out
