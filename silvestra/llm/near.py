"""N-gram Jaccard join by token-combination prefixes.

A document is the set of its word n-grams (lower case, runs of non-space bytes; a text of fewer
than ``n`` words has one n-gram, all of it). All pairs of documents with a Jaccard similarity of at
least ``threshold`` are found exactly:

1. Tasks count their n-grams, slice by slice, and sample those that are rare in a slice; those that
   are frequent over all form one table of bounded size (its least frequency doubles until it fits).
   It orders n-grams from rare to frequent and gives the class. The order and classes only steer the
   work; no pair depends on their being exact.
2. Sets that can't have a partner go: of a set of n, a partner holds t n at least, so of its n-grams in
   three quarters of the hash space all but n - t n at most are in some other set as well. These n-grams meet in
   buckets, 4 bytes each, and only sets with so many shared ones go on, as a table of their own.
3. A set's prefix in that order is taken so long that a similar set must share a signature with it:
   a single n-gram of the rare class or a pair of n-grams of the frequent class. With overlap at
   least a, and p the prefix's length of which m are frequent, p - min(m, 1) >= size - a + 1.
   The smaller set of a pair needs the shorter, indexing prefix (a = 2t/(1+t) size), the larger one
   the probing prefix (a = t size); a signature says whether it lies in the first.
4. Signatures travel packed to buckets by hash, which give the candidate pairs; long lists of one
   signature are split, and their pieces meet in tasks of their own.
5. Candidates meet in blocks of bounded size, first with the parities of their n-grams in some bits,
   which give an upper bound of the similarity; those that pass meet whole sets and are verified exactly.

Pairs are never rows of a table: a block's are steps of codes in its own list of sets, which takes far
less than a byte a pair in a cluster, and of those verified only each set's number of links and a spanning
forest of the block go on. A set's name leads with its least n-gram, so that near copies lie together.

Before step 3 comes a round of stars: of the sets with one least n-gram by some hash each is compared
with one of them. That puts most of a cluster in one known class. Of the lists of step 4 just pairs of sets
of different known classes go on, and frequencies of n-grams count each known class once, so a cluster's
pairs are never listed. Where only classes are asked for (``classes``, ``deduplicated``) that is all: a pair
left out joins two sets that are known to be connected. For the links (``grouped``) the sets of a known
class meet each other directly, in blocks of bounded size in which products of matrices count what all pairs
have in common, so only numbers of links are written. ``links`` alone lists all pairs.

Equal sets are one node throughout, so groups of exact copies cost nothing and are never paired up.
The result is a row for each document: its class and its number of links.

Defined results: null doc_ids have no row (``deduplicated`` keeps their rows); documents whose texts
are null or without words are a class each, with no link; rows that share a doc_id are one document
with the links of each different set, and none of its own. Extra columns of any name are ignored, or
carried by ``deduplicated``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..store import deleted, released
from .common import BROADCAST_ROWS, buckets_for, kept, stored, table, text_bytes
from .tokens import Words, chunks, mix, planes, squeezed, unplaned, unsqueezed

#: Copies with a tenth of their words edited have a Jaccard similarity of 0.5 to 0.6 in 3-grams; texts of their own have less than 0.25.
N, THRESHOLD = 3, 0.5
#: N-grams with a hash below this take part in the sieve: three quarters.
_SIEVED = np.uint64(3 << 62)
#: Document frequency from which an n-gram is of the class indexed by pairs.
PAIRED = 4096
#: Rows of the table of frequent n-grams; the count within a slice that reports one, and of how many of the other occurrences one is.
FREQUENT_ROWS, TASK_COUNT, SAMPLED = 1_000_000, 4, 64
_TASK_GRAMS = 2_000_000
#: Sets of one signature from which their pairs are the work of several tasks; pairs held by a task.
LONG_LIST, _HELD_PAIRS = 2048, 500_000
#: Bytes of the sets of a group, and the pairs that they are in; two groups meet in a task.
GROUP_BYTES, GROUP_PAIRS = 16 << 20, 1_000_000
_LEVEL_BITS = 6
#: Bytes of text of a group when parities meet, and the pairs that its sets may have within a label of names.
PARITY_TEXT, LABEL_PAIRS = 192 << 20, 4_000_000
#: Codes of pairs held in a task before those that repeat go.
_HELD_CODES = 8_000_000
#: Hashes by which sets with one least n-gram are compared with one of them.
STARS = 8
#: Sets of a part of a known class, of which two meet in a task; how far apart the parts are that meet in a round.
PART_SETS, ROUND = 8192, 2
#: Pairs of sets that are counted at once; bytes of a matrix; the share of the sets from which an n-gram has a column of its own.
_CELLS, _MATRIX_BYTES, _DENSE = 4 << 20, 32 << 20, 64
_PACKED = "block long, names binary, sizes binary, codes binary"
_PACKED_SCHEMA = pa.schema([("block", pa.int64()), ("names", pa.binary()), ("sizes", pa.binary()), ("codes", pa.binary())])


def _sets(batch: pa.RecordBatch, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of each text, in order of the texts, and the text of each."""
    words = Words(batch.column("text"), lower=True)
    hashes, owner = words.grams(n)
    return _distinct(hashes, owner)


def _distinct(values: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(values)
    order = order[np.argsort(owner[order].astype(np.uint16 if len(owner) == 0 or owner.max() < 65536 else np.int64), kind="stable")]
    values, owner = values[order], owner[order]
    if len(values):
        new = np.r_[True, (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])]
        values, owner = values[new], owner[new]
    return values, owner


def _keys(hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts that have a set, and the set's name: 16 bits of its least n-gram, then 48 of a hash of all of it."""
    heads = np.r_[0, np.flatnonzero(np.diff(owner)) + 1] if len(owner) else np.zeros(0, np.int64)
    if not len(heads):
        return owner[heads], np.zeros(0, np.uint64)
    mixed = mix(hashes + np.uint64(0x9E37))
    least = mix(np.minimum.reduceat(mixed, heads)) >> np.uint64(48)
    return owner[heads], least << np.uint64(48) | mix(np.add.reduceat(mixed, heads)) >> np.uint64(16)


class _Once:
    """Tells which sets a task sees for the first time."""

    def __init__(self) -> None:
        self.seen: set[int] = set()

    def new(self, key: np.ndarray) -> np.ndarray:
        out = np.zeros(len(key), bool)
        for k, x in enumerate(key.tolist()):
            if x not in self.seen:
                self.seen.add(x)
                out[k] = True
        return out

    def only(self, hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The n-grams and texts of the new sets, and their keys."""
        at, key = _keys(hashes, owner)
        new = self.new(key)
        if new.all():
            return hashes, owner, key
        chosen = np.repeat(new, np.diff(np.r_[np.flatnonzero(np.r_[True, np.diff(owner) != 0]), len(owner)])) if len(owner) else np.zeros(0, bool)
        return hashes[chosen], owner[chosen], key[new]


def _labelled(batch: pa.RecordBatch, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """N-grams and texts of the sets that a document answers for, and the place of each set in the flat list of those.

    ``sets`` lists those of a document; one without a list answers for all of its sets, which have the place -1.
    """
    hashes, owner = _sets(batch, n)
    at, key = _keys(hashes, owner)
    listed = batch.column("sets")
    place, known, free = {int(x): k for k, x in enumerate(listed.flatten().to_numpy())}, np.full(len(key), -1), listed.is_null().to_numpy(False)[at]
    if place:
        known = np.array([place.get(x, -1) for x in key.view(np.int64).tolist()], np.int64)
    mine = (known >= 0) | free
    sizes = np.diff(np.r_[np.flatnonzero(np.r_[True, np.diff(owner) != 0]), len(owner)]) if len(owner) else np.zeros(0, np.int64)
    every = np.repeat(mine, sizes)
    return hashes[every], owner[every], known[mine]


def _survey(n: int, t: float, counting: bool = True):
    """Unless ``counting`` is off, rows (0, n-gram, count) of n-grams frequent in a slice of this task; (1, set, doc_id); (2, set, 0) of sets with too few n-grams in the sieve.

    Of the n-grams that are rare in a slice, (3, n-gram, 1) for a share of their occurrences, so that
    those that are frequent over many slices show too.
    """

    def rows(kind: int, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a.view(np.int64)), pa.array(b.astype(np.int64))], ["kind", "a", "b"])

    def counted(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        values = np.sort(np.concatenate(held))
        heads = np.r_[0, np.flatnonzero(values[1:] != values[:-1]) + 1]
        values, counts = values[heads], np.diff(np.r_[heads, len(values)])
        often = counts >= TASK_COUNT
        some = ~often & (mix(values + np.bitwise_xor.reduce(values)) % np.uint64(SAMPLED) < counts.astype(np.uint64))
        yield rows(0, values[often], counts[often])
        yield rows(3, values[some], np.ones(some.sum(), np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in chunks(batches):
            hashes, owner = _sets(batch, n)
            if not len(hashes):
                continue
            at, key = _keys(hashes, owner)
            yield rows(1, key, batch.column("doc_id").to_numpy(zero_copy_only=False)[at])
            every, seen = (np.bincount(o, minlength=batch.num_rows)[at] for o in (owner, owner[hashes < _SIEVED]))
            free = key[seen <= every - np.ceil(t * every - 1e-9).astype(np.int64)]
            yield rows(2, free, np.zeros(len(free), np.int64))
            if not counting:
                continue
            held.append(hashes)
            size += len(hashes)
            if size >= _TASK_GRAMS:
                yield from counted(held)
                held, size = [], 0
        if held:
            yield from counted(held)

    return run


def _sieved(n: int, n_buckets: int):
    """Of each set: its size, and its n-grams in the sieve, packed by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once = _Once()
        for batch in chunks(batches):
            hashes, owner, key = once.only(*_sets(batch, n))
            if not len(hashes):
                continue
            heads = np.r_[0, np.flatnonzero(np.diff(owner)) + 1]
            size = np.diff(np.r_[heads, len(owner)])
            node = np.repeat(np.arange(len(heads)), size)
            low = hashes < _SIEVED
            node, hashes = node[low], hashes[low]
            seen = np.bincount(node, minlength=len(heads))
            bucket = ((hashes >> np.uint64(34)) % np.uint64(n_buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            bucket, short, node = bucket[order], hashes[order].astype(np.uint32), node[order]
            edges = np.flatnonzero(np.diff(bucket)) + 1
            out: list[list] = [[], [], [], [], []]
            for lo, hi in zip(np.r_[0, edges], np.r_[edges, len(bucket)], strict=True):
                own = node[lo:hi]
                at = np.r_[0, np.flatnonzero(np.diff(own)) + 1] if hi > lo else np.zeros(0, np.int64)
                if hi > lo:
                    sizes = np.stack([size[own[at]], seen[own[at]]], 1).astype(np.uint32)
                    for k, v in enumerate((int(bucket[lo]), key[own[at]].tobytes(), sizes.tobytes(), np.diff(np.r_[at, hi - lo]).astype(np.uint32).tobytes(), short[lo:hi].tobytes())):
                        out[k].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), *(pa.array(x, pa.binary()) for x in out[1:])], ["bucket", "sets", "sizes", "counts", "grams"])

    return run


def _shared(parts: int):
    """Of one bucket: how many n-grams each set shares with others, where any, by part of the sets."""

    def run(bucket: pa.Table) -> pa.Table:
        of = np.repeat(np.arange(sum(len(x.as_py()) for x in bucket["sets"]) // 8), _joined(bucket["counts"], np.uint32))
        keys, sizes = _joined(bucket["sets"], np.uint64), _joined(bucket["sizes"], np.uint32).reshape(-1, 2)
        grams, once = _joined(bucket["grams"], np.uint32), np.zeros(len(keys), bool)
        once[np.unique(keys, return_index=True)[1]] = True  # of equal sets, one
        grams, of = grams[once[of]], of[once[of]]
        order = np.argsort(grams, kind="stable")
        grams, of = grams[order], of[order]
        heads = np.r_[0, np.flatnonzero(grams[1:] != grams[:-1]) + 1] if len(grams) else np.zeros(0, np.int64)
        several = np.maximum.reduceat(of, heads) != np.minimum.reduceat(of, heads) if len(grams) else np.zeros(0, bool)
        of = of[np.repeat(several, np.diff(np.r_[heads, len(grams)]))]
        key = keys[of]
        order = np.argsort(key, kind="stable")
        key, of = key[order], of[order]
        heads = np.r_[0, np.flatnonzero(key[1:] != key[:-1]) + 1] if len(key) else np.zeros(0, np.int64)
        counts = np.diff(np.r_[heads, len(key)])
        key, size = key[heads], sizes[of[heads]]
        part = (key % np.uint64(parts)).astype(np.int32)
        row = np.empty(len(key), [("key", "<u8"), ("n", "<u4"), ("seen", "<u4"), ("shared", "<u4")])
        row["key"], row["n"], row["seen"], row["shared"] = key, size[:, 0], size[:, 1], counts
        chosen = np.unique(part)
        return pa.table([pa.array(chosen, pa.int32()), pa.array([row[part == p].tobytes() for p in chosen], pa.binary())], ["part", "rows"])

    return run


def _partnered(t: float):
    """The sets of one part that share as much as a partner takes."""

    def run(group: pa.Table) -> pa.Table:
        row = _joined(group["rows"], np.dtype([("key", "<u8"), ("n", "<u4"), ("seen", "<u4"), ("shared", "<u4")]))
        row = row[np.argsort(row["key"], kind="stable")]
        heads = np.r_[0, np.flatnonzero(row["key"][1:] != row["key"][:-1]) + 1] if len(row) else np.zeros(0, np.int64)
        shared = np.add.reduceat(row["shared"].astype(np.int64), heads) if len(row) else np.zeros(0, np.int64)
        row = row[heads]
        spare = row["n"] - np.ceil(t * row["n"] - 1e-9).astype(np.int64)
        return pa.table([pa.array(row["key"][shared >= row["seen"] - spare].view(np.int64))], ["set"])

    return run


def _ranked(hashes: np.ndarray, owner: np.ndarray, frequent: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sets with each n-gram led by the level of its frequency, sorted within the set."""
    names, levels = frequent
    level = np.zeros(len(hashes), np.uint64)
    if len(names):
        at = np.minimum(np.searchsorted(names, hashes), len(names) - 1)
        level = np.where(names[at] == hashes, levels[at], 0).astype(np.uint64)
    ranked = (level << np.uint64(64 - _LEVEL_BITS)) | (hashes >> np.uint64(_LEVEL_BITS))
    order = np.argsort(ranked)
    order = order[np.argsort(owner[order].astype(np.uint16 if len(owner) == 0 or owner.max() < 65536 else np.int64), kind="stable")]
    return ranked[order], owner[order], level[order]


def _signatures(n: int, t: float, paired: int, n_buckets: int, frequent, labelled: bool = False):
    """The signatures of each set, packed by bucket; with ``labelled`` also its label, by default its name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, once = frequent.value, _Once()
        for batch in chunks(batches):
            hashes, owner, *known = _labelled(batch, n) if labelled else _sets(batch, n)
            every = _keys(hashes, owner)[1]
            hashes, owner, key = once.only(hashes, owner)
            if not len(hashes):
                continue
            label = key.view(np.int64)
            if labelled:  # of the sets that are new; what is told of one is the same everywhere
                told = dict(zip(every.tolist(), known[0].tolist(), strict=True))
                place = np.array([told[x] for x in key.tolist()], np.int64)
                named = batch.column("labels").flatten().to_numpy()
                label = np.where(place < 0, label, named[place] if len(named) else 0)
            ranked, owner, level = _ranked(hashes, owner, table)
            heads = np.r_[0, np.flatnonzero(np.diff(owner)) + 1]
            size = np.diff(np.r_[heads, len(owner)])
            node = np.repeat(np.arange(len(heads)), size)
            place = np.arange(len(owner)) - heads[node]
            often = level >= np.log2(paired)
            rare = size - np.add.reduceat(often.astype(np.int64), heads)

            def prefix(least: np.ndarray, size=size, rare=rare) -> np.ndarray:
                need = size - np.maximum(1, np.ceil(least - 1e-9)).astype(np.int64) + 1
                return np.minimum(size, need + (need > rare))

            index, probe = prefix(2 * t / (1 + t) * size), prefix(t * size)
            single = (place < probe[node]) & ~often
            sig, of, first = [ranked[single]], [node[single]], [place[single] < index[node[single]]]
            for k in np.flatnonzero(probe - rare >= 2):
                i, j = np.triu_indices(probe[k] - rare[k], 1)
                own = ranked[heads[k] + rare[k] : heads[k] + probe[k]]
                sig.append(mix(own[i] * np.uint64(0xD1342543DE82EF95) + own[j]))
                of.append(np.full(len(i), k))
                first.append(rare[k] + j < index[k])
            sig, of, first = np.concatenate(sig), np.concatenate(of), np.concatenate(first)
            sig = (mix(sig) & ~np.uint64(1)) | first.astype(np.uint64)
            bucket = ((sig >> np.uint64(40)) % np.uint64(n_buckets)).astype(np.int32)
            order = np.lexsort((of, bucket))
            bucket, sig, of = bucket[order], sig[order], of[order]
            edges = np.flatnonzero(np.diff(bucket)) + 1
            out: list[list] = [[] for _ in range(5 + labelled)]
            for lo, hi in zip(np.r_[0, edges], np.r_[edges, len(bucket)], strict=True):
                own = of[lo:hi]
                at = np.r_[0, np.flatnonzero(np.diff(own)) + 1]
                for k, v in enumerate((int(bucket[lo]), key[own[at]].tobytes(), size[own[at]].astype(np.uint32).tobytes(), np.diff(np.r_[at, hi - lo]).astype(np.uint32).tobytes(), sig[lo:hi].tobytes(), *[label[own[at]].tobytes()] * labelled)):
                    out[k].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), *(pa.array(x, pa.binary()) for x in out[1:])], ["bucket", "sets", "sizes", "counts", "sigs", *["labels"] * labelled])

    return run


def _joined(column, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() for x in column), kind)


def _unique_pairs(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.lexsort((b, a))
    a, b, n, m = a[order], b[order], n[order], m[order]
    if len(a):
        new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
        a, b, n, m = a[new], b[new], n[new], m[new]
    return a, b, n, m


def _packed_rows(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [()] * 5
    return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int32(), *[pa.binary()] * 4), strict=True)], ["kind", "a", "b", "n", "m"])


def _candidates(t: float):
    """Of one bucket: rows of kind 0 hold pairs of sets; rows of kind 1 two pieces of a long list of sets with one signature.

    In a list, sorted by size, each set in its indexing prefix meets the larger ones. The pieces of
    long lists meet in tasks of their own, so no list is one task's work.
    """

    def run(bucket: pa.Table) -> pa.Table:
        sigs = _joined(bucket["sigs"], np.uint64)
        name = sigs >> np.uint64(1)
        order = np.argsort(name)
        ranked = name[order]
        same = ranked[1:] == ranked[:-1]
        order = order[np.r_[False, same] | np.r_[same, False]] if len(order) else order
        of = np.repeat(np.arange(sum(len(x.as_py()) for x in bucket["sets"]) // 8), _joined(bucket["counts"], np.uint32))[order]
        key, size = _joined(bucket["sets"], np.uint64)[of], _joined(bucket["sizes"], np.uint32)[of]
        name, index = name[order], (sigs[order] & np.uint64(1)).astype(bool)
        order = np.lexsort((key, size, name))
        name, key, size, index = name[order], key[order], size[order], index[order]
        if len(name):
            new = np.r_[True, (name[1:] != name[:-1]) | (key[1:] != key[:-1])]
            name, key, size, index = name[new], key[new], size[new], index[new]
        rows: list[tuple] = []
        heads = np.r_[0, np.flatnonzero(name[1:] != name[:-1]) + 1, len(name)] if len(name) else np.zeros(1, np.int64)
        length = np.diff(heads)
        for k in np.flatnonzero(length > LONG_LIST):
            pieces = [slice(i, min(i + LONG_LIST // 2, heads[k + 1])) for i in range(heads[k], heads[k + 1], LONG_LIST // 2)]
            flagged = (size << np.uint32(1)) | index
            for i, x in enumerate(pieces):
                for y in pieces[i:]:
                    if size[y.start] * t <= size[x.stop - 1] + 1e-9 and index[x].any():
                        rows.append((1, key[x].tobytes(), key[y].tobytes() if x is not y else b"", flagged[x].tobytes(), size[y].tobytes() if x is not y else b""))
        at, d, held = np.flatnonzero(index & np.repeat(length <= LONG_LIST, length)), 1, 0
        found: list[tuple] = []
        while len(at):
            at = at[at + d < len(name)]
            at = at[(name[at] == name[at + d]) & (size[at + d] * t <= size[at] + 1e-9)]
            found.append((key[at], key[at + d], size[at], size[at + d]))
            held += len(at)
            d += 1
            if held > _HELD_PAIRS or not len(at):
                rows += [(0, *(x[i : i + _HELD_PAIRS].tobytes() for x in pairs)) for pairs in [_unique_pairs(*(np.concatenate(x) for x in zip(*found, strict=True)))] for i in range(0, len(pairs[0]), _HELD_PAIRS)]
                found, held = [], 0
        return _packed_rows(rows)

    return run


def _expanded(t: float):
    """(a, b, n, m): the pairs of sets, and their sizes."""

    def out(a, b, n, m) -> pa.RecordBatch:
        swap = a.view(np.int64) > b.view(np.int64)
        a, b, n, m = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, m, n), np.where(swap, n, m)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(n.astype(np.int32)), pa.array(m.astype(np.int32))], ["a", "b", "n", "m"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for kind, *raw in zip(*(batch.column(c) for c in ("kind", "a", "b", "n", "m")), strict=True):
                a, b, n, m = (np.frombuffer(x.as_py(), k) for x, k in zip(raw, (np.uint64, np.uint64, np.uint32, np.uint32), strict=True))
                if kind.as_py() == 0:
                    yield out(a, b, n, m)
                    continue
                index, n, own = (n & np.uint32(1)).astype(bool), n >> np.uint32(1), not len(b)
                if own:
                    b, m = a, n
                meet = index[:, None] & (m[None, :] * t <= n[:, None] + 1e-9)
                i, j = np.nonzero(np.triu(meet, 1) if own else meet)
                yield out(a[i], b[j], n[i], m[j])

    return run


def _unique(codes: np.ndarray) -> np.ndarray:
    codes = np.sort(codes)
    return codes[np.r_[True, codes[1:] != codes[:-1]]] if len(codes) else codes


def _coded(codes: np.ndarray) -> bytes:
    """Ascending codes of pairs, as differences."""
    return squeezed(planes(np.diff(codes, prepend=0), 6))


def _places(names: np.ndarray, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    codes = np.cumsum(unplaned(unsqueezed(raw), 6).astype(np.int64))
    i = codes // max(1, len(names))
    return i, codes - i * len(names)


def _packed_pairs(block: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> pa.RecordBatch:
    """Pairs of sets by block: a block's sets, ascending, their sizes and the codes of its pairs, each once."""
    order = np.argsort(block, kind="stable")
    block, a, b, n, m = (x[order] for x in (block, a, b, n, m))
    heads = np.r_[0, np.flatnonzero(np.diff(block)) + 1, len(block)] if len(block) else np.zeros(1, np.int64)
    rows = []
    for lo, hi in zip(heads[:-1], heads[1:], strict=True):
        names, at, place = np.unique(np.r_[a[lo:hi], b[lo:hi]], return_index=True, return_inverse=True)
        codes = _unique(place[: hi - lo].astype(np.int64) * len(names) + place[hi - lo :])
        rows.append((int(block[lo]), names.tobytes(), np.r_[n[lo:hi], m[lo:hi]][at].astype(np.uint32).tobytes(), _coded(codes)))
    columns = list(zip(*rows, strict=True)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _PACKED_SCHEMA.types, strict=True)], schema=_PACKED_SCHEMA)


def _unpacked(rows: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(names, sizes, places of a, places of b) of each row."""
    for names, sizes, codes in zip(rows["names"], rows["sizes"], rows["codes"], strict=True):
        names = np.frombuffer(names.as_py(), np.uint64)
        yield names, np.frombuffer(sizes.as_py(), np.uint32), *_places(names, codes.as_py())


def _tiled(t: float, bounds: np.ndarray):
    """The pairs of rows of ``_candidates``, packed by the ranges of names that they lie in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pairs in _expanded(t)(batches):
            a, b = (pairs.column(c).to_numpy().view(np.uint64) for c in "ab")
            x, y = (np.searchsorted(bounds, k, "right") for k in (a, b))
            yield _packed_pairs(np.minimum(x, y) * (len(bounds) + 1) + np.maximum(x, y), a, b, *(pairs.column(c).to_numpy() for c in "nm"))

    return run


def _listed(t: float, bounds: np.ndarray):
    """Of one bucket: its pairs packed by block, and with no block the pieces of long lists (a, b, n, m)."""

    def run(bucket: pa.Table) -> pa.Table:
        found = _candidates(t)(bucket)
        kind = found["kind"].to_numpy()
        short, long = (found.filter(pa.array(kind == k)) for k in (0, 1))
        out = pa.Table.from_batches(list(_tiled(t, bounds)(iter(short.to_batches()))), _PACKED_SCHEMA)
        pieces = pa.table([pa.nulls(len(long), pa.int64()), *(long[c] for c in "abnm")], [*_PACKED_SCHEMA.names, "m"])
        return pa.concat_tables([out.append_column("m", pa.nulls(len(out), pa.binary())), pieces])

    return run


def _ragged(first: np.ndarray, count: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(k, place) for count[k] places from first[k] on, about ``_HELD_PAIRS`` at a time."""
    ends, at = np.cumsum(count), 0
    while at < len(count):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _HELD_PAIRS, "right")))
        c = count[at:to]
        k = np.repeat(np.arange(at, to), c)
        yield k, first[k] + np.arange(len(k)) - np.repeat(np.cumsum(c) - c, c)
        at = to


def _crossed(t: float, bounds: np.ndarray):
    """As ``_listed``, but only of pairs of sets of different labels.

    In a list, the sets that haven't its commonest label meet the others; a list of one label has no pairs.
    """

    def blocked(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> pa.RecordBatch:
        swap = a.view(np.int64) > b.view(np.int64)
        a, b, n, m = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, m, n), np.where(swap, n, m)
        x, y = (np.searchsorted(bounds, k, "right") for k in (a, b))
        return _packed_pairs(np.minimum(x, y) * (len(bounds) + 1) + np.maximum(x, y), a, b, n, m)

    def run(bucket: pa.Table) -> pa.Table:
        sigs = _joined(bucket["sigs"], np.uint64)
        of = np.repeat(np.arange(sum(len(x.as_py()) for x in bucket["sets"]) // 8), _joined(bucket["counts"], np.uint32))
        key, label, size = _joined(bucket["sets"], np.uint64)[of], _joined(bucket["labels"], np.int64)[of], _joined(bucket["sizes"], np.uint32)[of].astype(np.int64)
        name, index = sigs >> np.uint64(1), (sigs & np.uint64(1)).astype(bool)
        order = np.lexsort((label, name))
        # The commonest label of each name.
        new = np.r_[True, np.diff(name[order]) != 0] if len(name) else np.zeros(0, bool)
        runs = np.flatnonzero(new | np.r_[True, np.diff(label[order]) != 0]) if len(name) else np.zeros(0, np.int64)
        length, which = np.diff(np.r_[runs, len(name)]), (np.cumsum(new) - 1)[runs]
        most = np.lexsort((length, which))
        most = most[np.r_[np.diff(which[most]) != 0, True]] if len(most) else most
        several, lists = np.bincount(which) > 1, np.empty(len(name), np.int64)
        lists[order] = np.cumsum(new) - 1
        main = label == label[order][runs[most]][lists]
        there = np.flatnonzero(several[lists]) if len(name) else np.zeros(0, np.int64)
        there = there[np.lexsort((key[there], size[there], lists[there]))]
        lists, key, label, size, index, main = (x[there] for x in (lists, key, label, size, index, main))
        if len(key):
            new = np.r_[True, (lists[1:] != lists[:-1]) | (key[1:] != key[:-1])]
            lists, key, label, size, index, main = (x[new] for x in (lists, key, label, size, index, main))
        ranked, rest, led = lists << 32 | size, np.flatnonzero(~main), np.flatnonzero(main & index)
        upto = np.searchsorted(ranked, lists[rest] << 32 | np.floor((size[rest] + 1e-9) / t).astype(np.int64), "right")
        after = np.where(index[rest], upto - rest - 1, 0)
        low = np.searchsorted(led, np.searchsorted(ranked, lists[rest] << 32 | np.ceil(size[rest] * t - 1e-9).astype(np.int64)))
        before = np.searchsorted(led, rest) - low
        pairs = np.bincount(lists[rest], after + before, int(lists.max()) + 1 if len(lists) else 0)
        long = pairs > LONG_LIST**2
        rows: list[tuple] = []
        flagged = (size.astype(np.uint32) << np.uint32(1)) | index
        for k in np.flatnonzero(long):
            lo, hi = np.searchsorted(lists, [k, k + 1])
            own, other = ([x[i : i + LONG_LIST // 2] for i in range(0, len(x), LONG_LIST // 2)] for x in (lo + np.flatnonzero(~main[lo:hi]), lo + np.flatnonzero(main[lo:hi])))
            meet = [(x, y) for i, x in enumerate(own) for y in own[i:]] + [p for x in own for y in other for p in ((x, y), (y, x))]
            for x, y in meet:
                if size[y[0]] * t <= size[x[-1]] + 1e-9 and index[x].any():
                    rows.append((None, key[x].tobytes(), key[y].tobytes() if x is not y else b"", flagged[x].tobytes(), size[y].astype(np.uint32).tobytes() if x is not y else b""))
        out = []
        short = ~long[lists[rest]]
        rest, after, low, before = rest[short], after[short], low[short], before[short]
        for k, y in _ragged(rest + 1, after):
            x = rest[k]
            good = label[x] != label[y]
            out.append(blocked(key[x[good]], key[y[good]], size[x[good]], size[y[good]]))
        for k, place in _ragged(low, before):
            x, y = led[place], rest[k]
            out.append(blocked(key[x], key[y], size[x], size[y]))
        made = pa.Table.from_batches(out, _PACKED_SCHEMA)
        columns = list(zip(*rows, strict=True)) or [()] * 5
        pieces = pa.table([pa.array(c, k) for c, k in zip(columns, (pa.int64(), *[pa.binary()] * 4), strict=True)], [*_PACKED_SCHEMA.names, "m"])
        return pa.concat_tables([made.append_column("m", pa.nulls(len(made), pa.binary())), pieces])

    return run


def _minima(n: int, n_buckets: int):
    """Of each set its least n-gram by each of ``STARS`` hashes, packed by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once = _Once()
        for batch in chunks(batches):
            hashes, owner, key = once.only(*_sets(batch, n))
            if not len(hashes):
                continue
            heads = np.r_[0, np.flatnonzero(np.diff(owner)) + 1]
            size = np.tile(np.diff(np.r_[heads, len(owner)]), STARS).astype(np.uint32)
            least = np.concatenate([mix(np.minimum.reduceat(mix(hashes + np.uint64(k + 1 << 40)), heads) + np.uint64(k)) for k in range(STARS)])
            key, bucket = np.tile(key, STARS), (least >> np.uint64(40)) % np.uint64(n_buckets)
            chosen = np.unique(bucket)
            yield pa.RecordBatch.from_arrays([pa.array(chosen.astype(np.int32)), *(pa.array([x[bucket == b].tobytes() for b in chosen], pa.binary()) for x in (key, size, least))], ["bucket", "sets", "sizes", "least"])

    return run


def _stars(t: float, bounds: np.ndarray):
    """Of one bucket: of the sets with one least n-gram one with each of the others, where their sizes allow it, packed by the ranges of names that they lie in."""

    def run(bucket: pa.Table) -> pa.Table:
        key, size, least = _joined(bucket["sets"], np.uint64), _joined(bucket["sizes"], np.uint32), _joined(bucket["least"], np.uint64)
        order = np.lexsort((mix(key ^ least), least))
        key, size, least = key[order], size[order], least[order]
        heads = np.r_[0, np.flatnonzero(np.diff(least)) + 1] if len(least) else np.zeros(0, np.int64)
        first = np.repeat(heads, np.diff(np.r_[heads, len(least)]))
        n, m = size.astype(np.int64), size[first].astype(np.int64)
        good = (key != key[first]) & (np.minimum(n, m) >= np.maximum(n, m) * t - 1e-9)
        a, b = key[first[good]].view(np.int64), key[good].view(np.int64)
        swap, n, m = a > b, m[good], n[good]
        a, b, n, m = np.where(swap, b, a).view(np.uint64), np.where(swap, a, b).view(np.uint64), np.where(swap, m, n), np.where(swap, n, m)
        x, y = (np.searchsorted(bounds, k, "right") for k in (a, b))
        return pa.Table.from_batches([_packed_pairs(np.minimum(x, y) * (len(bounds) + 1) + np.maximum(x, y), a, b, n, m)], _PACKED_SCHEMA)

    return run


def _merged(group: pa.Table) -> pa.Table:
    """The pairs of a block, each once, as one row."""
    every, at = np.unique(_joined(group["names"], np.uint64), return_index=True)
    sizes, held, count = _joined(group["sizes"], np.uint32)[at], [], 0
    for names, _, i, j in _unpacked(group):
        place = np.searchsorted(every, names)
        held.append(place[i] * len(every) + place[j])
        count += len(i)
        if count >= _HELD_CODES:
            held = [_unique(np.concatenate(held))]
            count = 0
    codes = _unique(np.concatenate(held)) if held else np.zeros(0, np.int64)
    return pa.table([[group["block"][0].as_py()], [every.tobytes()], [sizes.tobytes()], [_coded(codes)]], schema=_PACKED_SCHEMA)


def _names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(to, set): the sets of each block."""
    for batch in batches:
        for block, names in zip(batch.column("block").to_pylist(), batch.column("names"), strict=True):
            names = np.frombuffer(names.as_py(), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(names), block)), pa.array(names)], ["to", "set"])


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, block, least, n, pairs) of each set of a block: the least set that it is paired with or itself, its size and its pairs."""
    for batch in batches:
        for block, (names, sizes, i, j) in zip(batch.column("block").to_pylist(), _unpacked(pa.Table.from_batches([batch])), strict=True):
            names, least = names.view(np.int64), names.view(np.int64).copy()
            np.minimum.at(least, i, names[j])
            np.minimum.at(least, j, names[i])
            pairs = np.bincount(i, minlength=len(names)) + np.bincount(j, minlength=len(names))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (names, np.full(len(names), block), least, sizes.astype(np.int64), pairs)], ["a", "block", "least", "n", "pairs"])


def _regrouped(rows: pa.Table, groups: pa.Table) -> pa.Table:
    """A block's pairs, packed by the groups of their sets."""
    name, part = groups["set"].to_numpy(), groups["part"].to_numpy()
    order = np.argsort(name)
    name, part, out = name[order], part[order], []
    for names, sizes, i, j in _unpacked(rows):
        own = part[np.searchsorted(name, names.view(np.int64))]
        x, y = np.minimum(own[i], own[j]), np.maximum(own[i], own[j])
        to = mix(mix(x.view(np.uint64)) + y.view(np.uint64)).view(np.int64)
        out.append(_packed_pairs(to, names[i], names[j], sizes[i], sizes[j]))
    return pa.Table.from_batches(out, _PACKED_SCHEMA)


def _passed(t: float):
    """What the parities leave of a block's pairs."""

    def run(rows: pa.Table, sets: pa.Table) -> pa.Table:
        sets = sets.combine_chunks()
        name = sets["set"].to_numpy()
        order, raw = np.argsort(name), [x.as_buffer() for x in sets["grams"]]
        name, out = name[order], []
        for names, sizes, i, j in _unpacked(rows):
            at = order[np.searchsorted(name, names.view(np.int64))]
            good = _may(t, at[i], at[j], sizes[i].astype(np.int64) + sizes[j], raw)
            i, j = i[good], j[good]
            out.append(_packed_pairs(np.full(len(i), rows["block"][0].as_py()), names[i], names[j], sizes[i], sizes[j]))
        return pa.Table.from_batches(out, _PACKED_SCHEMA)

    return run


def _rooted(i: np.ndarray, j: np.ndarray, label: np.ndarray) -> np.ndarray:
    """The least node that each node is connected with by the pairs i, j; at first each node's own number."""
    while True:
        new = label.copy()
        np.minimum.at(new, i, label[j])
        np.minimum.at(new, j, label[i])
        new = new[new]
        if (new == label).all():
            return new
        label = new


def _forest(t: float):
    """(kind, a, b, n) as ``_linked`` has, but only a spanning forest of a block's pairs of at least the threshold."""

    def run(rows: pa.Table, sets: pa.Table) -> pa.Table:
        found = _verified(t)(rows, sets)
        a, b = found["a"].to_numpy(), found["b"].to_numpy()
        name = np.unique(np.r_[a, b])
        label = _rooted(np.searchsorted(name, a), np.searchsorted(name, b), np.arange(len(name)))
        tree = label < np.arange(len(name))
        k = int(tree.sum())
        return pa.table([pa.array(x) for x in (np.ones(k, np.int32), name[tree], name[label[tree]], np.zeros(k, np.int64))], ["kind", "a", "b", "n"])

    return run


def _linked(t: float):
    """Of a block's pairs of at least the threshold, but those of one known class: rows of kind 0 (a, 0, n) hold the documents that sets are linked with there; 1 (a, b, 0) a spanning forest; 2 (a, b, 0) the links of two sets that both share documents with other sets, which have negative numbers of documents."""

    def run(rows: pa.Table, sets: pa.Table) -> pa.Table:
        name, at = np.unique(sets["set"].to_numpy(), return_index=True)
        docs, known, pairs = sets["docs"].to_numpy()[at], sets["label"].to_numpy()[at], []
        for names, _, i, j in _unpacked(rows):
            names = names.view(np.int64)
            of = known[np.searchsorted(name, names)]
            other = of[i] != of[j]  # pieces of long lists may hold pairs of one class, which are counted where that meets
            pairs.append((names[i[other]], names[j[other]]))
        a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
        found = _verify(t)(pa.table([pa.array(a), pa.array(b)], ["a", "b"]), sets)
        a, b = found["a"].to_numpy(), found["b"].to_numpy()
        i, j, label = np.searchsorted(name, a), np.searchsorted(name, b), np.arange(len(name))
        near = np.bincount(i, np.abs(docs)[j], len(name)) + np.bincount(j, np.abs(docs)[i], len(name))
        label = _rooted(i, j, label)
        some, tree, both = near > 0, label < np.arange(len(name)), (docs[i] < 0) & (docs[j] < 0)
        columns = (np.r_[name[some], name[tree], a[both]], np.r_[np.zeros(some.sum(), np.int64), name[label[tree]], b[both]], np.r_[near[some].astype(np.int64), np.zeros(tree.sum() + both.sum(), np.int64)])
        kind = np.repeat(np.arange(3, dtype=np.int32), [some.sum(), tree.sum(), both.sum()])
        return pa.table([pa.array(x) for x in (kind, *columns)], ["kind", "a", "b", "n"])

    return run


def _routed(n: int, groups: int, nearest: int, farthest: int):
    """The sets of known classes, sent to where a part of a class meets another that is so far apart; small classes lie together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once = _Once()
        for batch in chunks(batches):
            hashes, owner, known = _labelled(batch, n)
            _, key = _keys(hashes, owner)
            heads = np.r_[0, np.flatnonzero(np.diff(owner)) + 1, len(owner)] if len(owner) else np.zeros(1, np.int64)
            label, parts, docs = (batch.column(c).flatten().to_numpy() for c in ("labels", "parts", "docs"))
            chosen = np.flatnonzero((known >= 0) & once.new(key))
            chosen = chosen[parts[known[chosen]] > 0] if len(chosen) else chosen
            rows: list[tuple] = []
            for k, at in zip(chosen.tolist(), known[chosen].tolist(), strict=True):
                several, grams = int(parts[at]), None
                own = int(mix(key[k : k + 1])[0] % np.uint64(several))
                for other in range(several):
                    if nearest <= abs(own - other) < farthest:
                        grams = grams or _steps(hashes[heads[k] : heads[k + 1]])
                        name = mix(label[at : at + 1].view(np.uint64))
                        to = mix(mix(name + np.uint64(min(own, other))) + np.uint64(max(own, other))) if several > 1 else name % np.uint64(groups)
                        rows.append((int(to.view(np.int64)[0]), int(key[k : k + 1].view(np.int64)[0]), int(label[at]), own, other, int(docs[at]), grams))
            columns = list(zip(*rows, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(columns, (*[pa.int64()] * 6, pa.binary()), strict=True)], ["to", "set", "label", "part", "other", "docs", "grams"])

    return run


def _common(a: list[np.ndarray], b: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """How many n-grams each of some sets has in common with each of others: the place of the first of them, and a row for each.

    N-grams that many sets have are columns of matrices; of the others the lists of sets are gone through.
    """
    sizes = np.array([len(x) for x in b])
    grams, column, often = np.unique(np.concatenate(b), return_inverse=True, return_counts=True)
    owner, order = np.repeat(np.arange(len(b)), sizes), np.argsort(column, kind="stable")
    starts, dense = np.cumsum(often) - often, often * _DENSE >= len(b)
    owner, columns = owner[order], np.flatnonzero(dense)
    width = max(1, _MATRIX_BYTES // 4 // len(b))
    step = max(1, _CELLS // len(b))
    for first in range(0, len(a), step):
        some = a[first : first + step]
        row, flat = np.repeat(np.arange(len(some)), [len(x) for x in some]), np.concatenate(some)
        place = np.minimum(np.searchsorted(grams, flat), len(grams) - 1)
        there = grams[place] == flat
        row, place = row[there], place[there]
        out, big = np.zeros((len(some), len(b)), np.float32), dense[place]
        for at in range(0, len(columns), width):
            part = columns[at : at + width]
            x, y = np.zeros((len(some), len(part)), np.float32), np.zeros((len(b), len(part)), np.float32)
            mine = big & (place >= part[0]) & (place <= part[-1])
            x[row[mine], np.searchsorted(part, place[mine])] = 1
            for k, which in _ragged(starts[part], often[part]):
                y[owner[which], k] = 1
            out += x @ y.T
        row, place = row[~big], place[~big]
        for k, which in _ragged(starts[place], often[place]):
            np.add.at(out, (row[k], owner[which]), 1)
        yield first, out


def _within(t: float):
    """Of the sets of known classes that meet: rows of kinds 0 and 2 as ``_linked`` has them."""

    def run(rows: pa.Table) -> pa.Table:
        name, label, part, other, docs = (rows[c].to_numpy() for c in ("set", "label", "part", "other", "docs"))
        at = np.unique(np.stack([label, name]), axis=1, return_index=True)[1]
        at, grams = at[np.lexsort((part[at], label[at]))], rows["grams"].combine_chunks()
        near, both = np.zeros(len(name), np.int64), []
        for own in np.split(at, np.flatnonzero(np.diff(label[at])) + 1):
            low, high = min(part[own[0]], other[own[0]]), max(part[own[0]], other[own[0]])
            x, y = own[part[own] == low], own[part[own] == high]
            if not len(x) or not len(y):
                continue
            sets = {k: np.cumsum(unplaned(grams[k].as_py(), 6), dtype=np.uint64) for k in own.tolist()}
            n, m = (np.array([len(sets[k]) for k in z.tolist()]) for z in (x, y))
            for first, common in _common([sets[k] for k in x.tolist()], [sets[k] for k in y.tolist()]):
                some = x[first : first + len(common)]
                good = common >= (n[first : first + len(common), None] + m) * ((t - 1e-9) / (1 + t - 1e-9))
                if low == high:
                    good[np.arange(len(some)), first + np.arange(len(some))] = False
                else:
                    near[y] += np.abs(docs[some]) @ good
                near[some] += good @ np.abs(docs[y])
                i, j = np.flatnonzero(docs[some] < 0), np.flatnonzero(docs[y] < 0)
                if len(i) and len(j):
                    k, l = np.nonzero(good[np.ix_(i, j)])  # noqa: E741
                    a, b = name[some[i[k]]], name[y[j[l]]]
                    both.append(np.stack([np.minimum(a, b), np.maximum(a, b)]))
        both = np.unique(np.concatenate(both, axis=1), axis=1) if both else np.zeros((2, 0), np.int64)
        some = near > 0
        columns = (np.repeat(np.array([0, 2], np.int32), [some.sum(), both.shape[1]]), np.r_[name[some], both[0]], np.r_[np.zeros(some.sum(), np.int64), both[1]], np.r_[near[some], np.zeros(both.shape[1], np.int64)])
        return pa.table([pa.array(c) for c in columns], ["kind", "a", "b", "n"])

    return run


def _verified(t: float):
    """(a, b, jaccard) of a block's pairs of at least the threshold."""

    def run(rows: pa.Table, sets: pa.Table) -> pa.Table:
        pairs = [(names[i].view(np.int64), names[j].view(np.int64)) for names, _, i, j in _unpacked(rows)]
        a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
        return _verify(t)(pa.table([pa.array(a), pa.array(b)], ["a", "b"]), sets)

    return run


def _set_rows(n: int, made):
    """(set, grams) of each text, of equal sets one a task; ``made`` gives the bytes of a set's n-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once = _Once()
        for batch in chunks(batches):
            hashes, owner = _sets(batch, n)
            if not len(hashes):
                continue
            _, key = _keys(hashes, owner)
            heads = np.r_[0, np.flatnonzero(np.diff(owner)) + 1, len(owner)]
            new = np.flatnonzero(once.new(key))
            yield pa.RecordBatch.from_arrays([pa.array(key[new].view(np.int64)), pa.array([made(hashes[heads[k] : heads[k + 1]]) for k in new], pa.binary())], ["set", "grams"])

    return run


def _parity(grams: np.ndarray) -> bytes:
    """For each value of an n-gram's last bits, whether the set has an odd number; two to four times as many bits as n-grams."""
    bits = max(64, 2 << int(len(grams) - 1).bit_length())
    return np.packbits((np.bincount((grams & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(bool)).tobytes()


def _may(t: float, a: np.ndarray, b: np.ndarray, n: np.ndarray, raw: list) -> np.ndarray:
    """Which pairs of rows, of n n-grams together, may be similar: sets that differ in h parities differ in h n-grams at least."""
    size = np.array([len(x) for x in raw])
    least, differ = np.minimum(size[a], size[b]), np.zeros(len(a), np.int64)
    for bits in np.unique(least):
        chosen = np.flatnonzero(least == bits)
        used = np.unique(np.r_[a[chosen], b[chosen]])
        folded = np.empty((len(used), bits // 8), np.uint64)
        for k, x in enumerate(used):  # parities of fewer bits are sums of those of more; packbits sets the first bit highest, so folding halves is right
            folded[k] = np.bitwise_xor.reduce(np.frombuffer(raw[x], np.uint64).reshape(-1, bits // 8), axis=0)
        x, y = np.searchsorted(used, a[chosen]), np.searchsorted(used, b[chosen])
        step = max(1, (4 << 20) // bits)
        for at in range(0, len(chosen), step):
            differ[chosen[at : at + step]] = np.bitwise_count(folded[x[at : at + step]] ^ folded[y[at : at + step]]).sum(axis=1)
    return (n - differ) // 2 >= np.ceil(n * t / (1 + t) - 1e-9)


def _bounded(t: float):
    """The pairs that may be similar."""

    def run(pairs: pa.Table, sets: pa.Table) -> pa.Table:
        row = {k: v for v, k in enumerate(sets["set"].to_pylist())}
        a, b = (np.array([row[k] for k in pairs[c].to_pylist()], np.int64) for c in "ab")
        good = _may(t, a, b, pairs["n"].to_numpy().astype(np.int64) + pairs["m"].to_numpy(), [x.as_buffer() for x in sets.combine_chunks()["grams"]])
        return pairs.select(["a", "b", "n", "m"]).filter(pa.array(good))

    return run


def _steps(grams: np.ndarray) -> bytes:
    """48 bits of each n-gram's hash, ascending, as differences: 5 bytes each when compressed."""
    return planes(np.diff(np.unique(grams >> np.uint64(16)), prepend=np.uint64(0)), 6)


def _verify(t: float):
    def run(pairs: pa.Table, sets: pa.Table) -> pa.Table:
        order = np.lexsort((pairs["b"].to_numpy(), pairs["a"].to_numpy()))
        a, b = pairs["a"].to_numpy()[order], pairs["b"].to_numpy()[order]
        sets = sets.combine_chunks()
        grams, column = {k: v for v, k in enumerate(sets["set"].to_pylist())}, sets["grams"]
        held: dict[int, np.ndarray] = {}

        def of(k: int) -> np.ndarray:
            if int(k) not in held:
                held[int(k)] = np.cumsum(unplaned(column[grams[int(k)]].as_py(), 6), dtype=np.uint64)
            return held[int(k)]

        score = np.zeros(len(a))
        edges = np.flatnonzero(np.diff(a)) + 1
        for lo, hi in zip(np.r_[0, edges], np.r_[edges, len(a)], strict=True):
            if hi == lo:
                continue
            own = of(a[lo])
            for at in range(lo, hi, 200):
                others = [of(k) for k in b[at : min(hi, at + 200)]]
                sizes = np.array([len(x) for x in others])
                every = np.concatenate(others)
                place = np.minimum(np.searchsorted(own, every), len(own) - 1)
                common = np.add.reduceat((own[place] == every).astype(np.int64), np.r_[0, np.cumsum(sizes)[:-1]])
                score[at : at + len(others)] = common / (len(own) + sizes - common)
        good = score >= t - 1e-9
        return pa.table([pa.array(a[good]), pa.array(b[good]), pa.array(score[good])], ["a", "b", "jaccard"])

    return run


def _ranges(spark, texts: DataFrame, sets: DataFrame) -> np.ndarray:
    """Where groups of names begin, all but the first: of bounded text and, as sets of one label are most often near copies, pairs.

    A row a label, of which there are 65,536, reaches the driver.
    """
    rows = texts.select("doc_id", F.octet_length("text").alias("size")).join(_small(sets.select("__id", "set")), F.col("doc_id") == F.col("__id"))
    rows = rows.groupBy(F.shiftrightunsigned("set", 48).alias("label")).agg(F.sum("size").alias("size"), F.count("*").alias("sets")).toArrow()
    order = np.argsort(rows["label"].to_numpy())
    label, size, count = (rows[c].to_numpy()[order].astype(np.int64) for c in ("label", "size", "sets"))
    limit, out, full = max(1, min(PARITY_TEXT, int(size.sum()) // 4)), [], 0.0
    for x, y, c in zip(label.tolist(), size.tolist(), count.tolist(), strict=True):
        parts = max(1, -(-c // int(LABEL_PAIRS**0.5)), -(-y // limit))
        share = max(y / limit, c * c / parts / LABEL_PAIRS) if parts == 1 else 1.0
        if full + share > 1 and full:
            out.append(x << 48)
            full = 0.0
        full += share
        out += [(x << 48) + (k << 48) // parts for k in range(1, parts)]
    return np.unique(np.array(out, np.uint64))


def _blocks(pairs: DataFrame, gram_bytes: float) -> DataFrame:
    """The packed pairs in blocks of bounded size; pairs of one cluster share few blocks.

    Each set takes the label of its least neighbour's least neighbour, which is one for most of a
    cluster, so a set is sent to about one block. Labels of more than ``GROUP_BYTES`` or
    ``GROUP_PAIRS`` are split into groups of sets; the others share groups. A block is a pair of groups.
    """
    there = kept(pairs.mapInArrow(_neighbours, "a long, block long, least long, n long, pairs long"))
    near = kept(there.groupBy("a").agg(F.min("least").alias("least"), F.first("n").alias("n"), F.sum("pairs").alias("pairs")))
    near = near.join(_small(near.select(F.col("a").alias("least"), F.col("least").alias("label"))), "least").select("a", "label", "n", "pairs")
    sizes = kept(near.groupBy("label").agg((F.sum("n") * gram_bytes / GROUP_BYTES).alias("x"), (F.sum("pairs") / GROUP_PAIRS).alias("y")).withColumn("parts", F.ceil(F.greatest("x", "y"))))
    x, y = sizes.where("parts <= 1").agg(F.sum("x"), F.sum("y")).first()
    groups = 1 + int(max(x or 0, y or 0))
    part = F.when(F.col("parts").isNull(), F.xxhash64(F.pmod(F.xxhash64("label"), F.lit(groups)))).otherwise(F.xxhash64("label", F.pmod(F.xxhash64("a"), F.col("parts"))))
    group = kept(near.join(_small(sizes.where("parts > 1").select("label", "parts")), "label", "left").select("a", part.alias("part")))
    told = there.select("block", "a").join(_small(group), "a").select("block", F.col("a").alias("set"), "part")
    return kept(pairs.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(_regrouped, _PACKED))


def _small(rows: DataFrame) -> DataFrame:
    """A side of a join: broadcast where its rows, of 16 to 32 bytes, are counted to be few, exchanged beyond."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def _met(texts: DataFrame, blocks: DataFrame, n: int, made, check, kind: str, docs: DataFrame | None = None) -> DataFrame:
    """What ``check`` says of each block's pairs, given what ``made`` makes of their sets, and by ``docs`` (set, docs, label) how many documents each has, and its known class."""
    routes = blocks.mapInArrow(_names, "to long, set long").distinct()
    routes = kept(routes if docs is None else routes.join(_small(docs), "set"))
    # Equal sets are made once by each task, so they may come several times.
    sets = texts.mapInArrow(_set_rows(n, made), "set long, grams binary").join(_small(routes), "set").select("to", "set", "grams", *([] if docs is None else ["docs", "label"]))
    return blocks.groupBy("block").cogroup(sets.groupBy("to")).applyInArrow(check, kind)


def _frequent(survey: DataFrame, paired: int):
    """The n-grams that are frequent, ascending, and the level of each, for all tasks."""
    counts = survey.where("kind in (0, 3)").groupBy("a").agg(F.sum(F.when(F.col("kind") == 0, F.col("b")).otherwise(0)).alias("n"), F.count_if(F.col("kind") == 3).alias("some"))
    counts = counts.select("a", (F.col("n") + F.when(F.col("some") >= 4, F.col("some") * SAMPLED).otherwise(0)).alias("n"))
    counts = kept(counts.where(F.col("n") >= min(16, paired)).select("a", F.floor(F.log2("n")).cast("int").alias("level")))
    per_level, least, rows = {r["level"]: r["count"] for r in counts.groupBy("level").count().collect()}, 99, 0
    for level in sorted(per_level, reverse=True):
        if (rows := rows + per_level[level]) > FREQUENT_ROWS:
            break
        least = level
    got = counts.where(F.col("level") >= least).toArrow()
    names, levels = got["a"].to_numpy().view(np.uint64), got["level"].to_numpy().astype(np.uint8)
    order = np.argsort(names)
    return survey.sparkSession.sparkContext.broadcast((names[order], levels[order]))


def _starred(texts: DataFrame, n: int, t: float, bounds: np.ndarray, size: int) -> DataFrame:
    """The rows of ``_forest`` of some pairs: each set with one of those that have its least n-gram, by each of ``STARS`` hashes."""
    least = texts.mapInArrow(_minima(n, buckets_for(size / 16)), "bucket int, sets binary, sizes binary, least binary")
    pairs = kept(least.groupBy("bucket").applyInArrow(_stars(t, bounds), _PACKED).groupBy("block").applyInArrow(_merged, _PACKED))
    released(texts.sparkSession)
    return _met(texts, _blocks(pairs, 8), n, _steps, _forest(t), "kind int, a long, b long, n long")


def _counted_within(told: DataFrame, classes: DataFrame, n: int, t: float) -> DataFrame:
    """Rows of kinds 0 and 2 as ``_linked`` has them, of all pairs in one known class; a round ships a set to ``2 * ROUND`` places at most."""
    most, groups = classes.agg(F.max("parts"), F.sum(F.when(F.col("parts") == 1, F.col("share")))).first()
    out = None
    for nearest in range(0, most or 1, ROUND):
        rows = told.where("sets is not null").mapInArrow(_routed(n, 1 + int(groups or 0), nearest, nearest + ROUND), "to long, set long, label long, part long, other long, docs long, grams binary")
        made = kept(rows.groupBy("to").applyInArrow(_within(t), "kind int, a long, b long, n long"))
        released(told.sparkSession)
        out = made if out is None else out.unionByName(made)
    return out


def _similar_sets(docs: DataFrame, n: int, t: float, paired: int, whole: bool, counted: bool = True) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(a, b, jaccard) of different sets, or unless ``whole`` the rows of ``_linked``, unless ``counted`` those of ``_forest``; (set, doc_id) of all documents; (set, first, docs): each set's least doc_id and their number; (set, doc_id, b) of documents of several sets, of which b is one."""
    if not 0.4 <= t <= 1:
        raise ValueError("the threshold must be 0.4 to 1")
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long"), "text").where("doc_id is not null and text is not null")
    size = text_bytes(docs)
    surveyed = stored(texts.mapInArrow(_survey(n, t, whole), "kind int, a long, b long"), codec="zstd")
    survey = spark.read.schema("kind int, a long, b long").parquet(surveyed)
    members = kept(survey.where("kind = 1").select(F.col("a").alias("set"), F.col("b").alias("doc_id")).distinct())
    firsts = kept(members.groupBy("set").agg(F.min("doc_id").alias("first"), F.count("*").alias("docs")))
    frequent = _frequent(survey, paired) if whole else None
    sieved = texts.mapInArrow(_sieved(n, buckets_for(size)), "bucket int, sets binary, sizes binary, counts binary, grams binary")
    shared = sieved.groupBy("bucket").applyInArrow(_shared(buckets_for(size / 6)), "part int, rows binary")
    going = shared.groupBy("part").applyInArrow(_partnered(t), "set long").unionByName(survey.where("kind = 2").select(F.col("a").alias("set"))).distinct()
    owned = kept(firsts.join(going, "set").select("set", "first", "docs"))
    chosen = kept(owned.groupBy(F.col("first").alias("__id")).agg(F.min("set").alias("set")))
    several = kept(members.join(members.groupBy("doc_id").agg(F.count("*").alias("sets"), F.min("set").alias("b")).where("sets > 1").select("doc_id", "b"), "doc_id").select("set", "doc_id", "b"))  # documents of several sets
    deleted(spark, surveyed)
    del sieved, shared, going, survey
    released(spark)  # what the sieve exchanged
    going = stored(texts.join(_small(chosen.select("__id")), F.col("doc_id") == F.col("__id"), "left_semi"), codec="zstd")
    texts = spark.read.schema(texts.schema).parquet(going)
    size, bounds = text_bytes(texts), _ranges(spark, texts, chosen)
    signs, lists = F.col("docs") * F.coalesce("sign", F.lit(1)), _listed
    docs = owned.join(_small(several.select("set", F.lit(-1).alias("sign")).distinct()), "set", "left").select("set", "first", signs.alias("docs"))
    if not whole:
        known = kept(_starred(texts, n, t, bounds, size))
        labels = kept(docs.join(components(known.select("a", "b")).select(F.col("node").alias("set"), "label"), "set", "left"))
        sizes = texts.groupBy("doc_id").agg(F.max(F.octet_length("text")).alias("size"))
        classes = labels.where("label is not null").join(_small(sizes.withColumnRenamed("doc_id", "first")), "first") if counted else labels.limit(0).withColumn("size", F.lit(0))
        classes = kept(classes.groupBy("label").agg(F.greatest(F.sum("size") / GROUP_BYTES, F.count("*") / PART_SETS).alias("share")).withColumn("parts", F.ceil("share").cast("int")))
        named = kept(labels.select("set", "docs", F.coalesce("label", "set").alias("label"))) if counted else None
        # Documents of one set without a label answer for it anyway.
        labels = labels.join(_small(several.select(F.col("doc_id").alias("first"), F.lit(True).alias("shared")).distinct()), "first", "left").where("label is not null or shared").join(_small(classes.select("label", "parts")), "label", "left")
        labels = labels.select(F.col("first").alias("__id"), F.struct("set", F.coalesce("label", "set").alias("label"), F.coalesce("parts", F.lit(0)).alias("parts"), "docs").alias("x")).groupBy("__id").agg(F.collect_list("x").alias("x"))
        labels = kept(labels.select("__id", F.col("x.set").alias("sets"), F.col("x.label").alias("labels"), F.col("x.parts").alias("parts"), F.col("x.docs").alias("docs")))
        told = kept(texts.join(_small(labels), F.col("doc_id") == F.col("__id"), "left").select("doc_id", "text", "sets", "labels", "parts", "docs"), codec="zstd")
        deleted(spark, going)
        texts, lists = told.select("doc_id", "text"), _crossed
        released(spark)  # stars
        within = _counted_within(told, classes, n, t) if counted else None
        leads = F.exists(F.arrays_zip("sets", "labels"), lambda x: x["sets"] == x["labels"])
        surveyed = stored(told.where(F.col("sets").isNull() | leads).select("doc_id", "text").mapInArrow(_survey(n, t), "kind int, a long, b long").where("kind in (0, 3)"), codec="zstd")
        frequent = _frequent(spark.read.schema("kind int, a long, b long").parquet(surveyed), paired)
        deleted(spark, surveyed)
        released(spark)  # what was surveyed
    packed = (texts if whole else told).mapInArrow(_signatures(n, t, paired, buckets_for(size * (1 - t) / 6 * 13), frequent, not whole), "bucket int, sets binary, sizes binary, counts binary, sigs binary" + ", labels binary" * (not whole))
    listed = stored(packed.groupBy("bucket").applyInArrow(lists(t, bounds), f"{_PACKED}, m binary"))
    del packed
    released(spark)  # signatures
    found = spark.read.schema(f"{_PACKED}, m binary").parquet(listed)
    long_lists = found.where("block is null").select(F.lit(1).alias("kind"), F.col("names").alias("a"), F.col("sizes").alias("b"), F.col("codes").alias("n"), "m")
    long_lists = long_lists.repartition(max(1, long_lists.count() // 16))
    rows = found.where("block is not null").drop("m").unionByName(long_lists.mapInArrow(_tiled(t, bounds), _PACKED))
    pairs = kept(rows.groupBy("block").applyInArrow(_merged, _PACKED))
    deleted(spark, listed)
    del found, long_lists, rows
    released(spark)  # lists of pairs
    pairs = kept(_met(texts, pairs, n, _parity, _passed(t), _PACKED))
    released(spark)  # parities
    blocks = _blocks(pairs, 8)
    if whole:
        return _met(texts, blocks, n, _steps, _verified(t), "a long, b long, jaccard double"), members, firsts, several
    if not counted:
        return _met(texts, blocks, n, _steps, _forest(t), "kind int, a long, b long, n long").unionByName(known), members, firsts, several
    linked = _met(texts, blocks, n, _steps, _linked(t), "kind int, a long, b long, n long", named)
    return linked.unionByName(known).unionByName(within), members, firsts, several


def links(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, paired: int = PAIRED) -> DataFrame:
    """doc_id_a < doc_id_b and their jaccard, of every pair of different sets; each set is named by its least doc_id."""
    similar, _, firsts, _ = _similar_sets(docs, n, threshold, paired, True)
    named = similar.join(firsts.select(F.col("set").alias("a"), F.col("first").alias("x")), "a").join(firsts.select(F.col("set").alias("b"), F.col("first").alias("y")), "b").where("x <> y")
    return named.groupBy(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b")).agg(F.round(F.max("jaccard"), 6).alias("jaccard"))


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the least node that each node of the edges (a, b) is connected with.

    Each round takes every node to its least neighbour, if that is less, follows those steps to their
    end, and goes on with the edges between what is left, of which there is at most half a round.
    """
    edges, done = kept(edges.select("a", "b").where("a <> b").distinct()), None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = kept(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("to")).select("node", F.least("node", "to").alias("label")))
        while True:
            far = _small(step.where("node <> label").toDF("at", "far"))
            new = kept(step.join(far, F.col("label") == F.col("at"), "left").select("node", F.coalesce("far", "label").alias("label"), F.col("far").isNotNull().alias("moved")))
            step = new.select("node", "label")
            if new.where("moved").isEmpty():
                break
        if done is None:
            done = step
        else:
            done = done.join(_small(step.toDF("at", "next")), F.col("label") == F.col("at"), "left").select("node", F.coalesce("next", "label").alias("label"))
        done = kept(done)
        edges = edges.join(_small(step.toDF("a", "x")), "a").join(_small(step.toDF("b", "y")), "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        edges = kept(edges)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")) if done is None else done


def grouped(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, paired: int = PAIRED) -> DataFrame:
    """doc_id, class_id, n_links of every document.

    A class is connected by pairs of at least the threshold; its id is the least doc_id in it. A link
    joins two texts of different documents: equal sets or sets of at least the threshold; links are
    counted by sets and their numbers of documents, so copies are never paired with one another.
    """
    return _classed(docs, n, threshold, paired, True)


def classes(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, paired: int = PAIRED) -> DataFrame:
    """doc_id, class_id of every document, as ``grouped`` has them; pairs of sets that are known to be connected aren't compared."""
    return _classed(docs, n, threshold, paired, False).select("doc_id", "class_id")


def _classed(docs: DataFrame, n: int, threshold: float, paired: int, counted: bool) -> DataFrame:
    """doc_id, class_id, n_links; unless ``counted``, the numbers of links are too low."""
    similar, members, firsts, several = _similar_sets(docs, n, threshold, paired, False, counted)
    similar = kept(similar)
    near = similar.where("kind = 0").groupBy(F.col("a").alias("set")).agg(F.sum("n").alias("near"))
    label = components(similar.where("kind = 1").select("a", "b").unionByName(several.select(F.col("set").alias("a"), "b")))
    both = similar.where("kind = 2").select("a", "b")
    both = both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b")))
    linked = kept(firsts.join(near, "set", "left").join(label.withColumnRenamed("node", "set"), "set", "left").select("set", "docs", "first", F.coalesce("label", "set").alias("label"), (F.col("docs") - 1 + F.coalesce("near", F.lit(0))).alias("n_links")))
    # Classes of several sets only; a set by itself is named by its least document.
    names = kept(linked.groupBy("label").agg(F.min("first").alias("class_id"), F.count("*").alias("sets")).where("sets > 1").select("label", "class_id"))
    info = kept(linked.join(_small(names), "label", "left").select("set", "docs", F.coalesce("class_id", "first").alias("class_id"), "n_links"))
    # Sets of more than 1 / 10,000 of all memberships are 10,000 at most; these meet their documents without an exchange.
    least = max(1000, members.count() // 10_000)
    often, rest = F.broadcast(info.where(F.col("docs") > least)), info.where(F.col("docs") <= least)
    told = members.join(often, "set").unionByName(members.join(F.broadcast(info.where(F.col("docs") > least).select("set")), "set", "left_anti").join(rest, "set")).select("doc_id", "class_id", "n_links")
    own = both.join(_small(several.select(F.col("set").alias("a"), "doc_id")), "a").join(_small(several.select(F.col("set").alias("b"), "doc_id")), ["b", "doc_id"]).select("doc_id", F.col("doc_id").alias("class_id"), F.lit(-1).cast("long").alias("n_links"))
    every = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return every.unionByName(told).unionByName(own).groupBy("doc_id").agg(F.min("class_id").alias("class_id"), F.sum("n_links").alias("n_links"))


def deduplicated(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of which the document is the least doc_id of its class; all columns as they are.

    Rows that share a doc_id go or stay together; rows with a null doc_id stay. The ids to go are
    broadcast only where their count, which is taken, is small.
    """
    gone = kept(classes(docs, n, threshold).where("doc_id <> class_id").select("doc_id"))
    rows, gone = docs.select(F.struct("*").alias("row")), gone.toDF("id")
    return rows.join(_small(gone), F.col("row.doc_id") == F.col("id"), "left_anti").select("row.*")


def op2_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return grouped(table(spark, sf_dir, "documents"))


OP2_SQL = f"""
WITH RECURSIVE w AS (SELECT DISTINCT doc_id, regexp_extract_all(lower(text), '[^\\t\\n\\f\\r ]+') w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
t AS (SELECT doc_id, list_sort(list_distinct([array_to_string(w[p : p + {N - 1}], ' ') FOR p IN range(1, greatest(len(w) - {N - 1}, 1) + 1)])) g FROM w WHERE len(w) > 0),
m AS (SELECT DISTINCT doc_id, md5(array_to_string(g, chr(10))) k FROM t),
g AS (SELECT DISTINCT md5(array_to_string(g, chr(10))) k, len(g) n, unnest(g) g FROM t),
o AS (SELECT a.k x, b.k y, a.n n, b.n m, count(*) c FROM g a JOIN g b ON a.g = b.g GROUP BY ALL),
s AS (SELECT x, y FROM o WHERE c / (n + m - c) >= {THRESHOLD} - 1e-9),
l AS (SELECT p.doc_id x, q.doc_id y FROM s JOIN m p ON p.k = s.x JOIN m q ON q.k = s.y WHERE p.doc_id <> q.doc_id),
e AS (SELECT DISTINCT x, y FROM l),
r AS (SELECT doc_id x, doc_id y FROM documents WHERE doc_id IS NOT NULL UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y)
SELECT r.x AS doc_id, min(r.y) AS class_id, coalesce(max(n.n), 0) AS n_links FROM r LEFT JOIN (SELECT x, count(*) n FROM l GROUP BY x) n ON n.x = r.x GROUP BY r.x
"""
