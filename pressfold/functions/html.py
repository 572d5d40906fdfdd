"""A small HTML tree on the standard library's tokenizer, and selectors over it.

Selectors are comma-separated alternatives of ``tag.class[attr][attr*='value']``
without combinators. An element matches if any alternative does; the first match
is the first in document order, the element itself included.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser

# Elements without an end tag, and those that end others implicitly.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
ENDS = {
    "p": {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"},
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"},
}
SCOPES = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "p": {"td", "th", "button", "object"}}
SILENT = {"script", "style", "template", "noscript"}


class Node:
    """An element; ``children`` holds elements and strings in order."""

    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None) -> None:
        self.tag, self.attrs, self.children = tag, attrs or {}, []

    def walk(self) -> Iterator[Node]:
        """This element and all below it, in document order."""
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(c for c in reversed(node.children) if isinstance(c, Node))

    def text(self) -> str:
        """The visible text, white space collapsed, zero-width spaces and soft hyphens left out."""
        parts: list[str] = []
        stack: list[Node | str] = [self]
        while stack:
            item = stack.pop()
            if isinstance(item, str):
                parts.append(item)
            elif item.tag == "br":
                parts.append(" ")
            elif item.tag not in SILENT:
                block = item.tag in ENDS["p"] or item.tag in ("li", "td", "th", "dt", "dd")
                if block:
                    stack.append(" ")
                stack.extend(reversed(item.children))
                if block:
                    parts.append(" ")
        return re.sub(r"[ \t\n\f\r\xa0]+", " ", re.sub("[\u200b\u00ad]", "", "".join(parts))).strip(" ")

    def get(self, name: str) -> str:
        return self.attrs.get(name, "")

    def select(self, selector: str) -> list[Node]:
        test = compiled(selector)
        return [n for n in self.walk() if test(n)]

    def first(self, selector: str) -> Node | None:
        test = compiled(selector)
        return next((n for n in self.walk() if test(n)), None)


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("#root")
        self.open = [self.root]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            own = self.open[k].tag
            if tag in ENDS.get(own, ()):
                del self.open[k:]
                break
            if tag in SCOPES and own in SCOPES[tag]:
                break
        node = Node(tag, {k: v or "" for k, v in reversed(attrs)})
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                return

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(data)


def parse(html: str) -> Node:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root


_PART = re.compile(r"\.([\w-]+)|\[\s*([\w-]+)\s*(?:(\*=|=)\s*'([^']*)'\s*)?\]")


@lru_cache(maxsize=512)
def compiled(selector: str):  # noqa: ANN201
    """A test for elements; class names and contained values are compared without case."""
    alternatives = []
    for own in re.split(r",(?![^\[]*\])", selector):
        own = own.strip()
        tag = re.match(r"[\w-]*", own).group().lower()
        parts = [(m.group(1), m.group(2), m.group(3), m.group(4)) for m in _PART.finditer(own[len(tag) :])]
        alternatives.append((tag, parts))

    def test(node: Node) -> bool:
        for tag, parts in alternatives:
            if tag and node.tag != tag:
                continue
            if node.tag == "#root":
                continue
            for klass, attr, operator, value in parts:
                if klass:
                    if klass.lower() not in node.get("class").lower().split():
                        break
                elif attr not in node.attrs or (operator == "*=" and value.lower() not in node.get(attr).lower()) or (operator == "=" and node.get(attr).lower() != value.lower()):
                    break
            else:
                return True
        return False

    return test


def fragment_text(html: str | None) -> str | None:
    """The visible text of a fragment; null for null."""
    return None if html is None else parse(html).text()
