"""A tolerant, linear-time reader of HTML into flat arrays of elements and texts.

Every search for the end of something is made once: what never ends runs to the end of the page.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

TEXT = "#text"
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Read as plain text up to their end tag, and no text of the page.
RAW = frozenset("script style textarea title iframe".split())
# Read as elements, but what is inside is no text of the page: always, or if their own end tag ends them.
HIDDEN = frozenset("svg select".split())
FALLBACK = frozenset("noscript template object".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt "
    "fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol "
    "p pre section summary table tbody td tfoot th thead title tr ul".split())
# A start tag ends an open element of these before it opens.
_P_ENDS = BLOCK - {"br", "td", "th", "tr", "tbody", "thead", "tfoot", "html", "head", "body"}
_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("tr", "td", "th"),
         "td": ("td", "th"), "th": ("td", "th"), "body": ("head",)}
# ... but not beyond one of these.
_WALLS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "option": ("select",), "tr": ("table",),
          "td": ("tr", "table"), "th": ("tr", "table")}

# A start tag that HTML doesn't know inside these ends them.
_SELECT_ENDS = (BLOCK - {"hr", "br", "legend"}) | {"input", "textarea", "select"}
_FOREIGN_ENDS = (BLOCK - {"title", "html", "caption"}) | frozenset(
    "b big code em embed i img meta nobr ruby s small span strong strike sub sup tt u var".split())
# ... but not inside one of these.
_FOREIGN_HTML = ("foreignobject", "annotation-xml", "mtext", "mi", "mo", "mn", "ms", "desc")

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_STOP = re.compile(r"""[>"']""")


@dataclass
class Dom:
    """Node 0 is the page. A text is a node with tag TEXT; `text` is empty for elements."""

    parent: list[int] = field(default_factory=lambda: [-1])
    tag: list[str] = field(default_factory=lambda: ["#page"])
    hint: list[str] = field(default_factory=lambda: [""])
    text: list[str] = field(default_factory=lambda: [""])


def parse(page: str) -> Dom:
    dom = Dom()
    parent, tags, hints, texts = dom.parent, dom.tag, dom.hint, dom.text
    stack: list[int] = [0]
    open_: dict[str, list[int]] = {}   # where each tag is open on the stack
    shut: set[int] = set()             # FALLBACK elements that their own end tag has ended
    quotes = {'"': True, "'": True}
    at, n = 0, len(page)

    def add(tag: str, hint: str, text: str) -> int:
        parent.append(stack[-1])
        tags.append(tag)
        hints.append(hint)
        texts.append(text)
        return len(parent) - 1

    def close(tag: str) -> None:
        while True:
            top = tags[stack.pop()]
            open_[top].pop()
            if top == tag:
                return

    def close_near(names: tuple[str, ...], walls: tuple[str, ...]) -> None:
        for k in range(len(stack) - 1, 0, -1):
            tag = tags[stack[k]]
            if tag in names:
                close(tag)
                return
            if tag in walls or tag in FALLBACK:
                return

    def last(*names: str) -> int:
        """Where the innermost of these is open on the stack, or 0."""
        return max((open_[t][-1] for t in names if open_.get(t)), default=0)

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            lt = n
        if lt > at:
            add(TEXT, "", html.unescape(page[at:lt]) if "&" in page[at:lt] else page[at:lt])
        if lt >= n:
            break
        two = page[lt + 1:lt + 2]
        if two == "!" or two == "?":
            end = page.find("-->", lt + 4) + 2 if page.startswith("<!--", lt) else page.find(">", lt)
            at = n if end < lt + 1 else end + 1
            continue
        closing = two == "/"
        name = _NAME.match(page, lt + 1 + closing)
        if name is None:
            if closing:
                end = page.find(">", lt)
                at = n if end < 0 else end + 1
            else:
                add(TEXT, "", "<")
                at = lt + 1
            continue
        # The tag's end: ">" outside quotes. A quote that never ends is no quote.
        k = name.end()
        while True:
            stop = _STOP.search(page, k)
            if stop is None:
                k = n
                break
            c = stop.group()
            if c == ">":
                k = stop.start()
                break
            end = page.find(c, stop.end()) if quotes[c] and page[stop.start() - 1] in "= \n\t" else -2
            if end == -1:
                quotes[c] = False
            k = end + 1 if end >= 0 else stop.end()
        tag, inside, at = name.group().lower(), page[name.end():k], k + 1
        if closing:
            if open_.get(tag):
                if tag in FALLBACK:
                    shut.add(stack[open_[tag][-1]])
                close(tag)
            continue
        if open_.get("select") and tag in _SELECT_ENDS and last("select") > last(*FALLBACK):
            close("select")
        foreign = last("svg", "math") > last(*_FOREIGN_HTML)
        if foreign and tag in _FOREIGN_ENDS and last("svg", "math") > last(*FALLBACK):
            while last("svg", "math") > last(*_FOREIGN_HTML, *FALLBACK):
                close("svg" if last("svg") > last("math") else "math")
            foreign = False
        if open_.get("p") and tag in _P_ENDS and last("p") > last(*FALLBACK):
            close("p")
        ends = _ENDS.get(tag)
        if ends and any(open_.get(e) for e in ends):
            close_near(ends, _WALLS.get(tag, ()))
        hint = ""
        if "=" in inside:
            hint = " ".join(a or b or c for a, b, c in _ATTRIBUTE.findall(inside)).lower()
        node = add(tag, hint, "")
        if tag in RAW and not foreign:
            # What is inside is no text of the page.
            low = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
            end = page.find(">", low.end()) if low else -1
            at = n if end < 0 else end + 1
        elif tag not in VOID and not inside.endswith("/"):
            open_.setdefault(tag, []).append(len(stack))
            stack.append(node)
    return _shown(dom, shut) if not (HIDDEN | FALLBACK).isdisjoint(tags) else dom


def _shown(dom: Dom, shut: set[int]) -> Dom:
    """`dom` without what is inside hidden elements.

    FALLBACK elements that aren't in `shut` were never ended: they are empty, and what follows them
    belongs to their parent.
    """
    out = Dom()
    place = [0]   # of each node: the new parent of its children, -1 for none
    for k in range(1, len(dom.parent)):
        up, tag = place[dom.parent[k]], dom.tag[k]
        if up < 0:
            place.append(-1)
            continue
        own = len(out.parent)
        place.append(-1 if tag in HIDDEN or k in shut else up if tag in FALLBACK else own)
        out.parent.append(up)
        out.tag.append(tag)
        out.hint.append(dom.hint[k])
        out.text.append(dom.text[k])
    return out
