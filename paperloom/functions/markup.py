"""A small document tree over the standard library's HTML parser, for use inside tasks."""

from __future__ import annotations

import re
from html.parser import HTMLParser

from paperloom.functions import fixed

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
# An opening tag of the value closes an open tag of the key.
CLOSED_BY = {
    "p": set(fixed.BLOCK_TAGS) - {"br"} | {"aside", "nav", "details", "pre", "form", "dl", "fieldset"},
    "li": {"li"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"},
    "option": {"option"}, "head": {"body"},
}
SCOPES = {"table", "ul", "ol", "div", "section", "article", "main", "body", "html", "blockquote", "td", "th"}


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag, attrs=None, parent=None):
        self.tag, self.attrs, self.children, self.parent = tag, attrs or {}, [], parent

    @property
    def classes(self):
        return (self.attrs.get("class") or "").split()

    def walk(self):
        """Elements below this one, in document order."""
        stack = [iter(self.children)]
        while stack:
            for child in stack[-1]:
                if isinstance(child, Node):
                    yield child
                    stack.append(iter(child.children))
                    break
            else:
                stack.pop()

    def strings(self):
        """Text nodes in document order, without recursion (documents may nest deeply)."""
        stack = [iter(self.children)]
        while stack:
            for child in stack[-1]:
                if isinstance(child, Node):
                    if child.tag not in ("script", "style"):
                        stack.append(iter(child.children))
                        break
                else:
                    yield child
            else:
                stack.pop()

    def text(self, sep=" "):
        return sep.join(s for s in (t.strip() for t in self.strings()) if s)

    def find(self, tag=None, cls=None, id_=None):
        return next(self.find_all(tag, cls, id_), None)

    def find_all(self, tag=None, cls=None, id_=None):
        for n in self.walk():
            if (tag is None or n.tag == tag) and (cls is None or cls in n.classes) and (
                    id_ is None or n.attrs.get("id") == id_):
                yield n


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("[document]")
        self.top = self.root

    def handle_starttag(self, tag, attrs):
        node = self.top
        while node is not None and node.tag != "[document]":
            if tag in CLOSED_BY.get(node.tag, ()):
                self.top = node.parent
                break
            if node.tag in SCOPES:
                break
            node = node.parent
        child = Node(tag, {k: v or "" for k, v in attrs}, self.top)
        self.top.children.append(child)
        if tag not in VOID:
            self.top = child

    def handle_startendtag(self, tag, attrs):
        self.top.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.top))

    def handle_endtag(self, tag):
        node = self.top
        while node is not None and node.tag != tag:
            node = node.parent
        if node is not None and node.parent is not None:
            self.top = node.parent

    def handle_data(self, data):
        self.top.children.append(data)


def parse(html: str) -> Node:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root


_HIDDEN = re.compile(r"display\s*:\s*none", re.IGNORECASE)
_DROPPED = {"script", "style", "meta", "link", "ix:header"}


def visible_lines(html: str) -> list[str]:
    """Stripped text nodes as lines; an empty line before and after every block element."""
    root = parse(html)
    body = root.find("body") or root
    blocks = set(fixed.BLOCK_TAGS)
    lines, stack = [], [(body, iter(body.children))]
    while stack:
        node, rest = stack[-1]
        for child in rest:
            if not isinstance(child, Node):
                text = child.strip()
                if text:
                    lines.append(text)
                continue
            if child.tag in _DROPPED or _HIDDEN.search(child.attrs.get("style", "")):
                continue
            if child.tag in blocks:
                lines.append("")
            stack.append((child, iter(child.children)))
            break
        else:
            stack.pop()
            if node.tag in blocks and node is not body:
                lines.append("")
    return lines


_BOLD = re.compile(fixed.BOLD_STYLE, re.IGNORECASE)


def heading_candidates(html: str) -> list[tuple[str, str]]:
    """(text, tag) of elements that look like headings, in document order."""
    out = []
    for n in parse(html).walk():
        if n.tag in _DROPPED or (n.tag not in fixed.HEADING_TAGS and n.tag not in fixed.HEADING_LIKE_TAGS):
            continue
        text = " ".join(n.text().split())
        if not 4 <= len(text) <= 200:
            continue
        if n.tag not in fixed.HEADING_TAGS:
            letters = re.sub(r"[^A-Za-z]", "", text)
            capitals = bool(letters) and letters.isupper() and len(text) <= 120
            if not (capitals or n.tag in ("strong", "b") or _BOLD.search(n.attrs.get("style", ""))):
                continue
        out.append((text, n.tag))
    return out


def body_paragraphs(container: Node) -> list[tuple[bool, str]]:
    """(is a direct child, text) of the paragraphs below a container that are not page furniture.

    One walk from the container down: whether furniture encloses a place is known before the place is
    reached. An element of the container's own tag starts a clean place.
    """
    tags, classes = frozenset(fixed.PARAGRAPH_NOISE_TAGS), frozenset(fixed.PARAGRAPH_NOISE_CLASSES)
    out: list[tuple[bool, str]] = []
    todo = [(child, False) for child in reversed(container.children) if isinstance(child, Node)]
    while todo:
        node, inside = todo.pop()
        marked = not classes.isdisjoint(node.classes)
        if node.tag == "p" and not inside and not marked:
            out.append((node.parent is container, node.text()))
        below = node.tag != container.tag and (inside or marked or node.tag in tags)
        todo += [(child, below) for child in reversed(node.children) if isinstance(child, Node)]
    return out


class Strings:
    """The visible strings of a document in order, and which of them lie below an element: texts of
    nested elements are slices of one list, and their lengths are known without building them."""

    def __init__(self, root: Node) -> None:
        self.items: list[str] = []
        self.ranges: dict[int, tuple[int, int]] = {}
        stack: list[tuple[Node, int, int]] = [(root, 0, 0)]
        while stack:
            node, at, start = stack.pop()
            if at == 0:
                start = len(self.items)
            hidden = node.tag in ("script", "style")
            while at < len(node.children) and not hidden:
                child = node.children[at]
                at += 1
                if isinstance(child, Node):
                    stack.append((node, at, start))
                    stack.append((child, 0, 0))
                    break
                text = child.strip()
                if text:
                    self.items.append(text)
            else:
                self.ranges[id(node)] = (start, len(self.items))
        self.sizes = [0]
        for text in self.items:
            self.sizes.append(self.sizes[-1] + len(text))

    def size(self, node: Node) -> int:
        a, b = self.ranges.get(id(node), (0, 0))
        return self.sizes[b] - self.sizes[a] + max(b - a - 1, 0)

    def text(self, node: Node) -> str:
        a, b = self.ranges.get(id(node), (0, 0))
        return " ".join(self.items[a:b])
