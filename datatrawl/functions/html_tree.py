"""The element tree of one page, by the standard library's tolerant parser."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

# Elements without content, elements that end an open paragraph, and elements
# that end an open one of their kind up to the element that holds them.
VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split())
ENDS_PARAGRAPH = frozenset(
    "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr"
    " main nav ol p pre section table ul".split())
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr"}), "th": ({"td", "th"}, {"tr"}), "a": ({"a"}, set()),
}
HIDDEN = frozenset(("script", "style"))


class _Tree(HTMLParser):
    """Nodes as [parent, last descendant, tag, attributes, text start, text end]."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.nodes: list[list] = [[None, 0, "#root", {}, 0, 0]]
        self.open = [0]
        self.depths: dict[str, list[int]] = {}  # of the open elements, by tag
        self.text: list[str] = []
        self.length = 0

    def _write(self, text: str) -> None:
        self.text.append(text)
        self.length += len(text)

    def _close_to(self, depth: int) -> None:
        while len(self.open) > depth:
            node = self.nodes[self.open.pop()]
            node[1], node[5] = len(self.nodes) - 1, self.length
            if self.open:
                self.depths[node[2]].pop()

    def _nearest(self, tags) -> int:
        return max((held[-1] for tag in tags if (held := self.depths.get(tag))), default=0)

    def _close_nearest(self, tags, bounds) -> None:
        depth = self._nearest(tags)
        if depth > self._nearest(bounds):
            self._close_to(depth)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ENDS_PARAGRAPH:
            self._close_nearest({"p"}, {"table", "td", "th", "button"})
            self._write(" ")
        elif tag == "br":
            self._write(" ")
        if tag in SIBLINGS:
            self._close_nearest(*SIBLINGS[tag])
        named: dict[str, str] = {}
        for name, value in attrs:
            named.setdefault(name, value or "")
        node_id = len(self.nodes)
        self.nodes.append([self.open[-1], node_id, tag, named, self.length, self.length])
        if tag not in VOID:
            self.depths.setdefault(tag, []).append(len(self.open))
            self.open.append(node_id)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in ENDS_PARAGRAPH:
            self._write(" ")
        self._close_nearest({tag}, ())

    def handle_data(self, data: str) -> None:
        if self.nodes[self.open[-1]][2] not in HIDDEN:
            self._write(data)


def tree_rows(page_id: int, html: str) -> Iterator[tuple]:
    """Rows of the node table; node ids are in document order, and the root is 0."""
    tree = _Tree()
    tree.feed(html)
    tree.close()
    tree._close_to(0)
    text = "".join(tree.text)
    for node_id, (parent, last, tag, attrs, start, end) in enumerate(tree.nodes):
        yield (page_id, node_id, parent, last, tag, attrs, start, end,
               text if node_id == 0 else None)
