"""Vectorised tokens over Arrow batches.

A token is a maximal run of bytes other than tab, newline, form feed, carriage return and space.
Hashes are polynomial (Rabin-Karp) modulo 2**64, taken from prefix sums, so that a word, an
n-gram of words or a window of any length costs the same few array passes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
_BASE, _STEP = 0x9E3779B97F4A7C15 | 1, 0xD1342543DE82EF95
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 12, 13, 32]] = True
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n or more powers of an odd base and of its inverse, modulo 2**64."""
    kept = _POWERS.get(base)
    if kept is None or len(kept[0]) < n:
        size = 1 << max(10, int(n - 1).bit_length())
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            both.append(np.cumprod(p, dtype=np.uint64))
        if size > 1 << 22:
            return both[0], both[1]
        kept = _POWERS[base] = (both[0], both[1])
    return kept


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: spreads a hash over all its bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Words:
    """Tokens of some texts: hash, first and last byte of each, and the text each belongs to.

    ``bounds[i]:bounds[i + 1]`` are the tokens of text i; a null text has none.
    """

    def __init__(self, texts: pa.Array, lower: bool) -> None:
        if not pa.types.is_large_string(texts.type):
            texts = texts.cast(pa.large_string())
        if lower:
            texts = pc.utf8_lower(texts)
        texts = pc.fill_null(texts, "")
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        _, off, data = texts.buffers()
        offsets = np.frombuffer(off, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        low, high = int(offsets[0]), int(offsets[-1])
        self.raw = np.frombuffer(data, np.uint8)[low:high] if data is not None and high > low else np.zeros(0, np.uint8)
        self.offsets = offsets - low
        n = len(self.raw)
        solid = np.zeros(n + 2, bool)
        solid[1:-1] = ~_SPACE[self.raw]
        first = solid[1:-1] & ~solid[:-2]
        last = solid[1:-1] & ~solid[2:]
        edges = self.offsets[(self.offsets > 0) & (self.offsets < n)]
        first[edges] = solid[1:-1][edges]  # texts lie next to one another
        last[edges - 1] = solid[1:-1][edges - 1]
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.start, self.offsets)
        power, inverse = powers(_BASE, n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((self.raw.astype(np.uint64) + np.uint64(1)) * power[:n], out=total[1:])
        self.hash = mix((total[self.end] - total[self.start]) * inverse[self.start])

    def __len__(self) -> int:
        return len(self.bounds) - 1

    @property
    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), np.diff(self.bounds))

    def windows(self, width: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Hash of every run of so many tokens within a text, and the index of its first token; a salt gives another hash."""
        n = len(self.hash)
        if n < width:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        power, inverse = powers(_STEP, n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((mix(self.hash + np.uint64(salt)) if salt else self.hash) * power[:n], out=total[1:])
        at = np.arange(n - width + 1)
        owner = self.text_of
        at = at[owner[at] == owner[at + width - 1]]
        return mix((total[at + width] - total[at]) * inverse[at]), at

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of a text's n-grams, and the text of each; a text of 1 to n - 1 tokens has one, all of it."""
        hashes, at = self.windows(n)
        owner = self.text_of[at] if len(at) else np.zeros(0, np.int64)
        sizes = np.diff(self.bounds)
        short = np.flatnonzero((sizes > 0) & (sizes < n))
        if len(short):
            extra = np.zeros(len(short), np.uint64)
            for k in range(n - 1):
                has = sizes[short] > k
                extra[has] = mix(extra[has] * np.uint64(_STEP) + self.hash[self.bounds[short[has]] + k] + np.uint64(k + 1))
            hashes, owner = np.concatenate([hashes, extra]), np.concatenate([owner, short])
        return hashes, owner


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about so many bytes of text; one longer text is a batch of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(lengths)
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + size, "right")))
            yield batch.slice(at, to - at)
            at = to
    pa.default_memory_pool().release_unused()


def planes(x: np.ndarray, width: int) -> bytes:
    """Numbers of so many bytes, byte by byte."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unplaned(raw: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(raw) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(width, -1).T
    return out.view("<u8").ravel()


def squeezed(raw: bytes) -> bytes:
    """Compressed, as planes of numbers have few different bytes."""
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(raw, asbytes=True)


def unsqueezed(raw: bytes) -> bytes:
    return pa.Codec("zstd", 1).decompress(raw[8:], int.from_bytes(raw[:8], "little"), asbytes=True)
