"""The mutable tree that a document is parsed into before it becomes node rows."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import Any

from ..functions.text import tokens_of, xml_escaped
from ..schema import TreeError, in_path

MAX_ATTRS, MAX_DEPTH = 63, 100
_BLANKS = " \t\n\r\f\v"


def repaired(text: str) -> str | None:
    """Whitespace of prose: lines joined by a space, paragraphs by an empty line; blank text is none."""
    if not text.strip(_BLANKS):
        return None
    if "\n" not in text:
        return text
    out, gap = "", 0
    for line in text.split("\n"):
        line = line if line.strip(_BLANKS) else ""
        if not line:
            gap += 1
            continue
        if out:
            out += "\n\n" if gap > 1 else " "
        out, gap = out + line.strip(_BLANKS), 1
    return out


class Node:
    """An element with its text, the tail that follows it, ordered attributes and children."""

    def __init__(self, element: str | None = None, text: str | None = None, attrs: dict[str, str] | None = None) -> None:
        self.element, self.text, self.tail = element, text, None
        self.attrs: dict[str, str] = dict(attrs or {})
        self.children: list[Node] = []
        self.parent: Node | None = None
        self.tokens: list[str] = []
        self.ignore = self.literal = self.strip = self.tokenize = False
        self.priority = 0

    # flags
    def add_flag(self, flag: str) -> Node:
        """Sets ignore, literal, strip or tokenize, on all nodes below as well."""
        for n in self.walk():
            setattr(n, flag, True)
            if flag == "strip" and n.text is not None:
                n.text = n.text.strip(_BLANKS)
            if flag == "tokenize":
                n.tokenize_text()
        return self

    # content
    def set_text(self, text: str | None) -> Node:
        if text is not None and not self.literal:
            text = repaired(text)
        self.text = text.strip(_BLANKS) if self.strip and text is not None else text
        if self.tokenize:
            self.tokenize_text()
        return self

    def set_tail(self, tail: str | None) -> Node:
        self.tail = tail if tail is None or self.literal else repaired(tail)
        return self

    def tokenize_text(self) -> Node:
        self.tokens = tokens_of(self.text)
        return self

    def add_token(self, token: str) -> Node:
        if token not in self.tokens:
            self.tokens.append(token)
        return self

    def attr(self, name: str) -> str | None:
        return self.attrs.get(name)

    def set_attr(self, name: str, value: str) -> Node:
        self.attrs[name] = value
        return self

    def remove_attr(self, name: str) -> Node:
        self.attrs.pop(name, None)
        return self

    def text_as_uint(self) -> int:
        return as_uint(self.text, 0)

    def attr_as_uint(self, name: str) -> int:
        return as_uint(self.attrs.get(name), 0)

    # structure
    def add(self, child: Node) -> Node:
        if child.parent is not None:
            raise TreeError("invalid", "the node has a parent already")
        child.parent = self
        self.children.append(child)
        return child

    def insert(self, element: str, text: str | None = None, **attrs: str) -> Node:
        """A new child with that text and those attributes."""
        child = self.add(Node(element, None, attrs))
        child.literal, child.strip, child.tokenize = self.literal, self.strip, self.tokenize
        return child.set_text(text) if text is not None else child

    def remove(self, child: Node) -> None:
        self.children.remove(child)
        child.parent = None

    def unlink(self) -> None:
        if self.parent is not None:
            self.parent.remove(self)

    def child(self, element: str, text: str | None = None) -> Node | None:
        return next((c for c in self.children if c.element == element and (text is None or c.text == text)), None)

    def first(self) -> Node | None:
        return self.children[0] if self.children else None

    def last(self) -> Node | None:
        return self.children[-1] if self.children else None

    def depth(self) -> int:
        return 0 if self.parent is None or self.parent.element is None else 1 + self.parent.depth()

    def sort_children(self, key: Callable[[Node], Any], reverse: bool = False) -> None:
        self.children.sort(key=key, reverse=reverse)

    def walk(self, order: str = "pre", depth: int | None = None, only: str = "all") -> Iterator[Node]:
        """This node and those below, ``depth`` levels at most; only "leaves" or "inner" nodes on demand."""
        wanted = only == "all" or (only == "leaves") == (not self.children)
        if order == "pre" and wanted:
            yield self
        if depth is None or depth > 0:
            for c in list(self.children):
                yield from c.walk(order, None if depth is None else depth - 1, only)
        if order == "post" and wanted:
            yield self

    def visit(self, visitor: Callable[[Node], Any], depth: int | None = None) -> None:
        """Calls the visitor in document order; a node that it unlinks isn't entered."""
        for c in list(self.children):
            if c.parent is self:
                visitor(c)
                if c.parent is self and (depth is None or depth > 1):
                    c.visit(visitor, None if depth is None else depth - 1)

    def export(self, header: bool = False, multiline: bool = False, indent: bool = False, collapse: bool = False) -> str:
        return ('<?xml version="1.0" encoding="UTF-8"?>\n' if header else "") + written(self, multiline, indent, collapse)


def as_uint(text: str | None, missing: int | None) -> int | None:
    """The leading number, hexadecimal after 0x; junk counts as 0."""
    if text is None:
        return missing
    if text.startswith("0x"):
        m = re.match(r"[0-9a-fA-F]+", text[2:])
        return int(m[0], 16) if m else 0
    m = re.match(r"\s*(\d+)", text)
    return min(int(m[1]), (1 << 64) - 1) if m else 0


def written(node: Node, multiline: bool, indent: bool, collapse: bool, level: int = 0) -> str:
    """The node as XML; nodes to be ignored are left out."""
    if level > MAX_DEPTH:
        raise TreeError("invalid", f"deeper than {MAX_DEPTH} levels")
    pad, line = "  " * level if indent else "", "\n" if multiline else ""
    kids = [c for c in node.children if not c.ignore]
    head = f"{pad}<{node.element}" + "".join(f' {k}="{xml_escaped(v)}"' for k, v in node.attrs.items())
    tail = xml_escaped(node.tail) if node.tail else ""
    if collapse and not kids and not node.text:
        return f"{head} />{tail}{line}"
    text = xml_escaped(node.text) if node.text else ""
    if not kids:
        return f"{head}>{text}</{node.element}>{tail}{line}"
    inner = "".join(written(c, multiline, indent, collapse, level + 1) for c in kids)
    return f"{head}>{text}{line}{inner}{pad}</{node.element}>{tail}{line}"


def rows_of(roots: list[Node], silo_id: str, first_id: int = 1) -> list[tuple]:
    """Node rows of a forest in document order, ids from ``first_id``; ignored subtrees are left out."""
    out: list[list] = []

    def visit(nodes: list[Node], parent: int | None, depth: int, path: str, anc: list[int]) -> None:
        if depth > MAX_DEPTH:
            raise TreeError("invalid", f"deeper than {MAX_DEPTH} levels")
        nodes, named, before = [n for n in nodes if not n.ignore], {}, None
        for k, n in enumerate(nodes, 1):
            if len(n.attrs) > MAX_ATTRS:
                raise TreeError("invalid", f"<{n.element}> has more than {MAX_ATTRS} attributes")
            me = first_id + len(out)
            named[n.element] = named.get(n.element, 0) + 1
            if before is not None:
                before[3] = me
            own = f"{path}/{in_path(n.element)}" if path else in_path(n.element)
            text, tail = (t if t is not None and t.strip(_BLANKS) else None for t in (n.text, n.tail))
            tokens = [t for t in n.tokens if t][:32]
            row = [silo_id, me, parent, None, me, depth, k, named[n.element], n.element, text, tail, [{"name": a, "value": v} for a, v in n.attrs.items()], tokens or None, bool(tokens), own, anc]
            out.append(row)
            visit(n.children, me, depth + 1, own, [*anc, me])
            row[4] = first_id + len(out) - 1
            before = row

    visit(roots, None, 0, "", [])
    return [tuple(r) for r in out]
