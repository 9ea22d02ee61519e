"""XML text to a tree, by expat; text and tails follow the rules of the node table."""

from __future__ import annotations

import re
from xml.parsers import expat

from ..schema import TreeError
from .dom import MAX_DEPTH, Node

_PROLOG = re.compile(r"^﻿?\s*(<\?xml[^>]*\?>)?", re.DOTALL)
_DOCTYPE = re.compile(r"<!DOCTYPE[^\[>]*(\[.*?\])?[^>]*>", re.DOTALL)
_LATIN = re.compile(rb"""<\?xml[^>]*encoding=["']([A-Za-z0-9._-]+)["']""")


def decoded(raw: bytes) -> str:
    """Bytes by their declared encoding, UTF-8 otherwise."""
    found = _LATIN.match(raw[:200])
    try:
        return raw.decode(found[1].decode() if found else "utf-8")
    except (UnicodeDecodeError, LookupError) as e:
        raise TreeError("invalid", f"not text: {e}") from e


def parsed(xml: str, literal: bool = False, strip: bool = False, tokenize: bool = False, locales: list[str] | None = None) -> Node:
    """The tree below a root without a name, whose children are the document's elements.

    With ``locales``, an element of another xml:lang is flagged to be ignored, and the others get a
    priority, the greater the earlier their language is in the list; those without one have their
    parent's. Text before any child has ended is the element's text; later text is the tail of the last
    child, of which each run (as comments and CDATA separate them) replaces the one before.
    """
    root = Node()
    root.literal, root.strip, root.tokenize = literal, strip, tokenize
    here: list[Node] = [root]
    runs: list[str] = []

    def flush() -> None:
        text = "".join(runs)
        runs.clear()
        if not text or len(here) < 2:
            return
        n = here[-1]
        if n.children:
            n.children[-1].set_tail(text)
        else:
            n.set_text((n.text or "") + text)

    def start(name: str, attrs: list[str]) -> None:
        flush()
        if len(here) > MAX_DEPTH + 1:
            raise TreeError("invalid", f"deeper than {MAX_DEPTH} levels")
        n = Node(name)
        n.literal, n.strip, n.tokenize = literal, strip, tokenize
        for k in range(0, len(attrs), 2):
            n.set_attr(attrs[k], attrs[k + 1])
        n.priority = here[-1].priority
        if locales is not None and (lang := n.attr("xml:lang")) is not None:
            if lang in locales:
                n.priority = len(locales) - locales.index(lang)
            else:
                n.ignore = True
        here[-1].add(n)
        here.append(n)

    def end(_: str) -> None:
        flush()
        n = here.pop()
        if tokenize:
            n.tokenize_text()

    body = _DOCTYPE.sub("", xml[_PROLOG.match(xml).end() :], count=1)
    reader = expat.ParserCreate()
    reader.ordered_attributes = True
    reader.buffer_text = False
    reader.StartElementHandler, reader.EndElementHandler = start, end
    reader.CharacterDataHandler = runs.append
    reader.CommentHandler = reader.ProcessingInstructionHandler = lambda *_: flush()
    reader.StartCdataSectionHandler = reader.EndCdataSectionHandler = flush
    try:
        reader.Parse("<forest>", False)
        reader.Parse(body, False)
        reader.Parse("</forest>", True)
    except expat.ExpatError as e:
        raise TreeError("invalid", f"not well formed: {e}") from e
    forest = root.children[0]
    root.remove(forest)
    for c in list(forest.children):
        c.unlink()
        root.add(c)
    return root


def one_language(root: Node) -> None:
    """Of children of the same name only those of the greatest priority stay, all the way down."""
    best: dict[str, int] = {}
    for c in root.children:
        if not c.ignore:
            best[c.element] = max(best.get(c.element, 0), c.priority)
    for c in root.children:
        if not c.ignore and c.priority < best[c.element]:
            c.ignore = True
        if not c.ignore:
            one_language(c)


def system_locales() -> list[str]:
    """The languages of the environment, most wanted first, and C."""
    import os

    out: list[str] = []
    for name in (os.environ.get("LANGUAGE") or os.environ.get("LC_ALL") or os.environ.get("LANG") or "").split(":"):
        base = name.split("@")[0].split(".")[0]
        for x in (base, base.split("_")[0]):
            if x and x not in out and x != "POSIX":
                out.append(x)
    return out if "C" in out else [*out, "C"]


def clean_locales(locales: list[str]) -> list[str]:
    """Without repeats and without names that carry an encoding."""
    return list(dict.fromkeys(x for x in locales if not x.endswith(".UTF-8")))
