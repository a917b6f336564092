"""A light tree of an HTML page, from the standard library's tokeniser.

Every walk is a loop over lists in document order, so pages may nest as deep as they like.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from functools import cached_property
from html import escape
from html.parser import HTMLParser

from quillstack.functions.lines import squeeze

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: An opening tag on the left ends an open element on the right.
ENDS = {"p": {"p"}, "li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}
SCOPES = frozenset(("ul", "ol", "table", "div", "blockquote", "dl", "select"))


class Index:
    """Elements and strings of a tree in document order.  An element's own are a slice of each list."""

    def __init__(self, root: Node):
        self.order: list[Node] = []
        self.strings: list[str] = []
        self.tagged: dict[str, list[Node]] = {}
        self.marked: dict[str, list[Node]] = {}
        self.matched: dict[str, tuple[list[int], list[Node]]] = {}
        self.texts: dict[tuple[int, int], str] = {}
        todo: list[Node | str | tuple[Node]] = [root]
        while todo:
            x = todo.pop()
            if isinstance(x, tuple):
                x[0].last, x[0].said_last = len(self.order), len(self.strings)
            elif isinstance(x, str):
                if x.strip():
                    self.strings.append(x.strip())
            else:
                x.index, x.first, x.said_first = self, len(self.order), len(self.strings)
                self.order.append(x)
                self.tagged.setdefault(x.tag, []).append(x)
                for name in x.attrs:
                    self.marked.setdefault(name, []).append(x)
                todo.append((x,))
                todo.extend(reversed(x.kids))

    def _likely(self, selector: str) -> list[Node]:
        """Elements that have what the selector names, in document order."""
        if selector[0] == ".":
            return self.marked.get("class", [])
        if selector[0] == "[":
            return self.marked.get(selector[1:].partition("*=")[0], [])
        return self.tagged.get(selector.partition("[")[0], [])

    def find(self, selector: str) -> tuple[list[int], list[Node]]:
        """Places and elements that match, in document order."""
        if selector not in self.matched:
            found = [n for n in self._likely(selector) if n.matches(selector)]
            self.matched[selector] = [n.first for n in found], found
        return self.matched[selector]


class Node:
    """An element; ``kids`` are elements and strings.  What is asked of the index needs ``number`` after a change."""

    __slots__ = ("tag", "attrs", "up", "kids", "index", "first", "last", "said_first", "said_last", "__dict__")

    def __init__(self, tag: str, attrs: dict[str, str], up: Node | None = None):
        self.tag, self.attrs, self.up, self.kids = tag, attrs, up, []

    def number(self) -> Node:
        """Makes a new index of this element and all below."""
        Index(self)
        return self

    def nodes(self) -> list[Node]:
        """All elements below, in document order."""
        return self.index.order[self.first + 1 : self.last]

    def strings(self) -> list[str]:
        """Non-blank strings below, trimmed."""
        return self.index.strings[self.said_first : self.said_last]

    def span(self, selector: str) -> tuple[int, int]:
        """Which of the index's matches stand below this element."""
        places = self.index.find(selector)[0]
        return bisect_left(places, self.first + 1), bisect_left(places, self.last)

    def select(self, selector: str) -> list[Node]:
        a, b = self.span(selector)
        return self.index.find(selector)[1][a:b]

    def holds(self, other: Node) -> bool:
        return self.first <= other.first < self.last

    @property
    def text(self) -> str:
        """All text on one line; elements with the same strings share it."""
        key, texts = (self.said_first, self.said_last), self.index.texts
        if key not in texts:
            texts[key] = squeeze(" ".join(self.strings()))
        return texts[key]

    @cached_property
    def markup(self) -> str:
        """HTML of an element of a tree that no longer changes."""
        return self.html()

    @property
    def anchors(self) -> list[Node]:
        return self.select("a[href]")

    @cached_property
    def classes(self) -> str:
        return self.attrs.get("class", "")

    def matches(self, selector: str) -> bool:
        """``.class``, ``tag``, ``tag[attribute]`` or ``[attribute*=part]``."""
        if selector[0] == ".":
            return selector[1:] in self.classes.split()
        if selector[0] == "[":
            name, part = selector[1:-1].split("*=")
            return part in self.attrs.get(name, "")
        tag, mark, name = selector.rstrip("]").partition("[")
        return self.tag == tag and (not mark or name in self.attrs)

    def copy(self) -> Node:
        made = Node(self.tag, self.attrs)
        todo = [(self, made)]
        while todo:
            old, new = todo.pop()
            for kid in old.kids:
                if isinstance(kid, Node):
                    twin = Node(kid.tag, kid.attrs)
                    new.add(twin)
                    todo.append((kid, twin))
                else:
                    new.add(kid)
        return made.number()

    def add(self, kid: Node | str) -> None:
        if isinstance(kid, Node):
            kid.up = self
        self.kids.append(kid)

    def remove(self) -> None:
        if self.up is not None:
            self.up.kids = [k for k in self.up.kids if k is not self]
            self.up = None

    def html(self) -> str:
        out, todo = [], [self]
        while todo:
            x = todo.pop()
            if isinstance(x, tuple):
                out.append(x[0])
            elif isinstance(x, str):
                out.append(escape(x, quote=False))
            else:
                out.append(f"<{x.tag}" + "".join(f' {k}="{escape(v)}"' for k, v in x.attrs.items()) + ">")
                if x.tag not in VOID:
                    todo.append((f"</{x.tag}>",))
                    todo.extend(reversed(x.kids))
        return "".join(out)


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("document", {})
        self.open: Counter[str] = Counter()

    def _leave(self) -> None:
        self.open[self.at.tag] -= 1
        self.at = self.at.up

    def _close(self, names: set[str], scopes: frozenset[str]) -> None:
        if not any(self.open[x] > 0 for x in names):
            return
        node = self.at
        while node.up is not None and node.tag not in scopes:
            if node.tag in names:
                while self.at is not node:
                    self._leave()
                self._leave()
                return
            node = node.up

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ENDS:
            self._close(ENDS[tag], SCOPES - ENDS[tag])
        made = Node(tag, {k: v or "" for k, v in attrs})
        self.at.add(made)
        if tag not in VOID:
            self.at = made
            self.open[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self._leave()

    def handle_endtag(self, tag: str) -> None:
        if tag not in VOID and self.open[tag] > 0:
            while self.at.tag != tag:
                self._leave()
            self._leave()

    def handle_data(self, data: str) -> None:
        self.at.add(data)


def tree(html: str | None) -> Node:
    """Tree of a page; text of scripts and styles is kept as strings of those elements."""
    for text in (html or "", (html or "").replace("<![", "&lt;![")):
        made = _Builder()
        try:
            made.feed(text)
            made.close()
            break
        except AssertionError:  # a marked section that the tokeniser does not know: taken as text
            continue
    return made.root.number()
