"""What bytes are, and how they become XML: content types, decompression, adapters."""

from __future__ import annotations

import gzip
import json
import lzma
import re
from collections.abc import Callable
from dataclasses import dataclass
from html.parser import HTMLParser
from xml.sax.saxutils import escape, quoteattr

from ..schema import TreeError
from .xml import decoded

XML, DESKTOP, QUIRK = "application/xml", "application/x-desktop", "text/x-quirk"
GZIP, XZ, ZSTD, UNKNOWN = "application/gzip", "application/x-xz", "application/zstd", "application/octet-stream"
_MAGIC = ((b"\x1f\x8b", GZIP), (b"\xfd7zXZ\x00", XZ), (b"\x28\xb5\x2f\xfd", ZSTD), (b"<?xml", XML), (b"[Desktop Entry]", DESKTOP))
_SUFFIXES = {".gz": GZIP, ".xz": XZ, ".zst": ZSTD, ".xml": XML, ".desktop": DESKTOP, ".quirk": QUIRK}


def content_type(name: str | None, raw: bytes) -> str:
    """By the first bytes, else by the name's extension, else unknown."""
    for magic, kind in _MAGIC:
        if raw.startswith(magic):
            return kind
    return next((kind for end, kind in _SUFFIXES.items() if (name or "").endswith(end)), UNKNOWN)


@dataclass
class Content:
    """What an adapter sees: a file's name, its content type as found, and its bytes."""

    name: str | None
    kind: str
    raw: bytes

    @property
    def text(self) -> str:
        return decoded(self.raw)


@dataclass
class Adapter:
    """Turns bytes of some types into others; a final one gives XML, whatever it looks like."""

    kinds: tuple[str, ...]
    convert: Callable[[Content], bytes | str]
    final: bool = False


def _zstd(c: Content) -> bytes:
    import io

    import zstandard

    return zstandard.ZstdDecompressor().stream_reader(io.BytesIO(c.raw), read_across_frames=True).read()


BUILT_IN = (Adapter((GZIP,), lambda c: gzip.decompress(c.raw)), Adapter((XZ,), lambda c: lzma.decompress(c.raw)), Adapter((ZSTD,), _zstd))


def as_xml(name: str | None, raw: bytes, adapters: tuple[Adapter, ...] = ()) -> str:
    """Applies adapters until XML is left; the name loses an extension each time. Blank input is an empty document."""
    if not raw.strip():
        return ""
    while True:
        kind = content_type(name, raw)
        if kind == XML or (kind == UNKNOWN and raw.lstrip()[:1] == b"<" and not any(UNKNOWN in a.kinds for a in adapters)):
            return decoded(raw)
        adapter = next((a for a in (*adapters, *BUILT_IN) if kind in a.kinds), None)
        if adapter is None:
            raise TreeError("unsupported", f"no adapter for {kind} of {name}")
        try:
            made = adapter.convert(Content(name, kind, raw))
        except (OSError, EOFError, lzma.LZMAError, ValueError) as e:
            raise TreeError("invalid", f"{name}: {e}") from e
        except Exception as e:
            if type(e).__name__ == "ZstdError":
                raise TreeError("invalid", f"{name}: {e}") from e
            raise
        before, raw = raw, made.encode() if isinstance(made, str) else made
        made = raw
        if adapter.final:
            return decoded(raw)
        if made == before:
            raise TreeError("invalid", f"{name}: an adapter for {kind} changes nothing")
        name = name.rpartition(".")[0] if name and "." in name else name


#: References by name or number, and what stands for an ampersand that begins none while a page is read.
_REFERENCES, _KEPT = r"#[0-9]+|#[xX][0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]*", "\x01"


class _Html(HTMLParser):
    VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.open: list[str] = []
        self.raw = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if not tag.replace("-", "").replace(":", "").isalnum() or not tag[0].isalpha():
            return
        if tag == "p" and "p" in self.open:
            self.handle_endtag("p")
        seen = {k: v or "" for k, v in attrs if k.replace("-", "").replace("_", "").isalnum() and k[0].isalpha()}
        self.out.append(f"<{tag}" + "".join(f" {k}={quoteattr(_legal(v.replace(_KEPT, '&')))}" for k, v in seen.items()))
        if tag in self.VOID:
            self.out.append("/>")
        else:
            self.out.append(">")
            self.open.append(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in self.open:
            while True:
                top = self.open.pop()
                self.out.append(f"</{top}>")
                if top == tag:
                    return

    def handle_data(self, data: str) -> None:
        if self.open:
            self.out.append(escape(_legal(data.replace(_KEPT, "&"))))


def _legal(text: str) -> str:
    return "".join(c for c in text if c in "\t\n\r" or " " <= c < "\ud800" or "" <= c < "￾" or c > "￿")


def html_to_xml(html: str, references: str = _REFERENCES) -> str:
    """Tolerates what browsers do: open paragraphs, empty elements, stray end tags.

    References count only with their semicolon; ``&amp`` without one is text as it stands, as are those that
    the pattern ``references`` doesn't match.
    """
    reader = _Html()
    reader.feed(re.sub(f"&(?!(?:{references});)", _KEPT, html.replace(_KEPT, "")))
    reader.close()
    return "".join(reader.out) + "".join(f"</{t}>" for t in reversed(reader.open))


def json_to_xml(text: str, root: str = "object") -> str:
    """Objects to elements by key, arrays to repeated ones; a key that is no XML name becomes ``item[@key]``."""

    def part(key: str, value: object) -> str:
        if isinstance(value, list):
            return "".join(part(key, v) for v in value)
        good = key.replace("_", "").replace("-", "").isalnum() and (key[0].isalpha() or key[0] == "_")
        head, tail = (key, key) if good else (f"item key={quoteattr(key)}", "item")
        if isinstance(value, dict):
            return f"<{head}>" + "".join(part(k, v) for k, v in value.items()) + f"</{tail}>"
        shown = "" if value is None else value if isinstance(value, str) else json.dumps(value)
        return f"<{head}>{escape(_legal(shown))}</{tail}>"

    return part(root, json.loads(text))
