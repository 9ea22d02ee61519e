"""String helpers, and the tokens of word search."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from functools import lru_cache

MAX_TOKENS = 32
_SPECIAL = {"ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "đ": "d", "ð": "d", "ł": "l", "þ": "th", "ı": "i"}
_WORDS = re.compile(r"\w+", re.UNICODE)


def replaced(text: str, search: str, replace: str) -> tuple[str, int]:
    """The text with every occurrence replaced, and how many there were; nothing matches an empty search."""
    return (text.replace(search, replace), text.count(search)) if search else (text, 0)


def union_of(*paths: str) -> str:
    """One query that returns what each of these does."""
    return "|".join(p for p in paths if p)


def escaped(text: str) -> str:
    """Text as it can stand in a path: slashes, tabs and newlines take a backslash."""
    return text.replace("/", "\\/").replace("\t", "\\t").replace("\n", "\\n")


def xml_escaped(text: str) -> str:
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = text.replace(sign, entity)
    return text


def folded(word: str) -> str:
    return unicodedata.normalize("NFC", word.casefold())


def plain(word: str) -> str | None:
    """A word's ASCII spelling, or None where it has none."""
    word = "".join(_SPECIAL.get(c, c) for c in word.casefold())
    out = "".join(c for c in unicodedata.normalize("NFKD", word) if not unicodedata.combining(c))
    return out if out.isascii() else None


@lru_cache(maxsize=1 << 16)
def forms_of(word: str) -> tuple[str, ...]:
    """A word folded, and its ASCII spelling if it has one."""
    return tuple(dict.fromkeys(x for x in (folded(word), plain(word)) if x))


def words_of(text: str, least_bytes: int = 0, most: int | None = None) -> list[str]:
    """Folded words in order, each followed by its ASCII spelling where that differs; ``most`` of them."""
    out: dict[str, None] = {}
    for word in _WORDS.finditer(text):
        for form in forms_of(word[0]):
            if form not in out and len(form.encode()) >= least_bytes:
                out[form] = None
                if most is not None and len(out) >= most:
                    return list(out)
    return list(out)


def tokens_of(text: str | None) -> list[str]:
    """What a node stores for search: words of three bytes at least, ``MAX_TOKENS`` of them."""
    return words_of(text or "", 3, MAX_TOKENS)


def search_words(text: str | None, search: str | None) -> bool:
    """Whether the search string, in any case, starts at the start of a word of the text."""
    if not text or not search or not (search[0].isascii() and search[0].isalnum()):
        return False
    low, find, at = text.lower(), search.lower(), 0
    while (at := low.find(find, at)) >= 0:
        if at == 0 or not (low[at - 1].isascii() and low[at - 1].isalnum()):
            return True
        at += 1
    return False


def search_tokens(tokens: list[str] | None, search: list[str] | None) -> bool:
    """Whether any token starts with any of the search tokens."""
    return any(t.startswith(s) for t in tokens or () for s in search or ())


def match_words(text: str | None, search: str | None) -> bool:
    """Whether every word sought starts some word of the text; for text beyond ASCII."""
    sought = {folded(w) for w in _WORDS.findall(search or "")}
    if not sought:
        return False
    for word in set(_WORDS.findall(text or "")):
        sought -= {s for s in sought if any(h.startswith(s) for h in forms_of(word))}
        if not sought:
            return True
    return False


def guid_of(*parts: str | bytes) -> str:
    """A GUID made of the SHA-1 of the joined parts."""
    raw = b"&".join(p.encode() if isinstance(p, str) else p for p in parts)
    return guid_text(hashlib.sha1(raw).hexdigest())


def guid_text(digest: str) -> str:
    return "-".join((digest[:8], digest[8:12], digest[12:16], digest[16:20], digest[20:32]))
