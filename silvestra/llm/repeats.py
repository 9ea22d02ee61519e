"""Substring dedup: Rabin-Karp hashes of every fixed-length token window, counted in Spark.

Tokens are runs of non-space bytes, letters' case kept. Every window of ``width`` tokens of every
text is hashed, twice, to 80 bits in all; hashes travel packed, in buckets, together with the document
and position. (Among 10**13 windows some 40 pairs of different ones have equal hashes by chance.)
A bucket holds all occurrences of its hashes, so the count there is the whole corpus's count.
Occurrences of a repeated window other than its first (lowest doc_id, then position) are to be
removed; windows that overlap or touch merge into maximal intervals.

Defined results: null doc_id or null text take no part (and stay as they are in ``removed``); rows
that repeat both doc_id and text are one document; rows that share a doc_id but not the text are
taken as occurrences by position, and each has the intervals of all cut that lie within it; texts
of fewer than ``width`` tokens have no window. Other columns of any name are carried untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, buckets_for, kept, text_bytes
from .tokens import Words, chunks, planes, unplaned

WIDTH = 50
_PACKED = "bucket int, docs binary, counts binary, hashes binary, more binary, places binary"
_SALT = 0x51ED270B
_RUNS = "doc_id long, first boolean, places binary"


def _pack(n_buckets: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            words = Words(batch.column("text"), lower=False)
            hashes, at = words.windows(width)
            if not len(hashes):
                continue
            more = words.windows(width, _SALT)[0] >> np.uint64(48)
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
            owner = words.text_of[at]
            place = (at - words.bounds[owner]).astype(np.uint32)
            bucket = ((hashes >> np.uint64(40)) % np.uint64(n_buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            bucket, hashes, more, owner, place = bucket[order], hashes[order], more[order], owner[order], place[order]
            edges = np.flatnonzero(np.diff(bucket)) + 1
            out: list[list] = [[], [], [], [], [], []]
            for lo, hi in zip(np.r_[0, edges], np.r_[edges, len(bucket)], strict=True):
                own = owner[lo:hi]
                heads = np.r_[0, np.flatnonzero(np.diff(own)) + 1]
                for k, v in enumerate((int(bucket[lo]), ids[own[heads]].tobytes(), np.diff(np.r_[heads, hi - lo]).astype(np.uint32).tobytes(), hashes[lo:hi].tobytes(), planes(more[lo:hi], 2), _gaps(place[lo:hi], heads))):
                    out[k].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), *(pa.array(x, pa.binary()) for x in out[1:])], ["bucket", "docs", "counts", "hashes", "more", "places"])

    return run


def _gaps(place: np.ndarray, heads: np.ndarray) -> bytes:
    """Ascending positions of each document as steps from one to the next; most have one byte."""
    steps = np.diff(place.astype(np.int64), prepend=0)
    steps[heads] = place[heads]
    return planes(steps, 4)


def _places(group: pa.Table) -> np.ndarray:
    out = []
    for counts, raw in zip(group["counts"], group["places"], strict=True):
        counts, steps = np.frombuffer(counts.as_py(), np.uint32).astype(np.int64), unplaned(raw.as_py(), 4).astype(np.int64)
        total, ends = np.cumsum(steps), np.cumsum(counts)
        out.append(total - np.repeat(np.r_[0, total[ends[:-1] - 1]], counts))
    return np.concatenate(out).astype(np.uint32)


def _joined(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() for x in column), kind)


def _repeated(group: pa.Table) -> pa.Table:
    """Of one bucket: each document's positions of repeated windows, split by whether they come first."""
    hashes, place = _joined(group["hashes"], np.uint64), _places(group)
    more = np.concatenate([unplaned(x.as_py(), 2) for x in group["more"]]).astype(np.uint16)
    order = np.argsort(hashes)
    ranked = hashes[order]
    same = ranked[1:] == ranked[:-1]
    order = order[np.r_[False, same] | np.r_[same, False]]
    doc = np.repeat(_joined(group["docs"], np.int64), _joined(group["counts"], np.uint32))[order]
    hashes, more, place = hashes[order], more[order], place[order]
    order = np.lexsort((place, doc, more, hashes))
    hashes, more, doc, place = hashes[order], more[order], doc[order], place[order]
    if len(hashes):  # the same place of the same document, from a repeated row, counts once
        new = np.r_[True, (hashes[1:] != hashes[:-1]) | (more[1:] != more[:-1]) | (doc[1:] != doc[:-1]) | (place[1:] != place[:-1])]
        hashes, more, doc, place = hashes[new], more[new], doc[new], place[new]
    same = (hashes[1:] == hashes[:-1]) & (more[1:] == more[:-1])
    first, later = np.r_[same, False] & ~np.r_[False, same], np.r_[False, same]
    out: list[list] = [[], [], []]
    for flag, chosen in ((True, first), (False, later)):
        d, p = doc[chosen], place[chosen]
        order = np.lexsort((p, d))
        d, p = d[order], p[order]
        edges = np.flatnonzero(np.diff(d)) + 1
        for lo, hi in zip(np.r_[0, edges], np.r_[edges, len(d)], strict=True):
            if hi > lo:
                out[0].append(int(d[lo]))
                out[1].append(flag)
                out[2].append(p[lo:hi].tobytes())
    return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.bool_()), pa.array(out[2], pa.binary())], ["doc_id", "first", "places"])


def _merge(width: int):
    """Positions of a whole partition, grouped by document and flag, to maximal intervals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, flags, out = batch.column("doc_id").to_pylist(), batch.column("first").to_pylist(), [[], [], [], []]
            for d, flag, parts in zip(ids, flags, batch.column("places"), strict=True):
                p = np.unique(np.frombuffer(b"".join(parts.as_py()), np.uint32).astype(np.int64))
                cut = np.flatnonzero(np.diff(p) > width)
                lo, hi = p[np.r_[0, cut + 1]], p[np.r_[cut, len(p) - 1]] + width
                out[0] += [d] * len(lo)
                out[1] += [flag] * len(lo)
                out[2].append(lo)
                out[3].append(hi)
            join = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.bool_()), join(out[2]), join(out[3])], ["doc_id", "first", "start", "stop"])

    return run


def repeated_intervals(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, start, stop (tokens from 0, stop excluded), first: every maximal run of repeated windows.

    ``first`` runs hold a window's first occurrence and stay; the others are the removal intervals.
    """
    texts = docs.select(F.col("doc_id").cast("long"), "text").where("doc_id is not null and text is not null")
    n_buckets = buckets_for(text_bytes(docs) / 6 * 14)
    packed = texts.mapInArrow(_pack(n_buckets, width), _PACKED)
    runs = packed.groupBy("bucket").applyInArrow(_repeated, _RUNS)
    whole = runs.groupBy("doc_id", "first").agg(F.collect_list("places").alias("places"))
    return whole.mapInArrow(_merge(width), "doc_id long, first boolean, start long, stop long")


def _cut(text: str, starts: list[int], stops: list[int]) -> str:
    raw = text.encode()
    words = Words(pa.array([text], pa.large_string()), lower=False)
    n, out, at = len(words.start), [], 0
    for lo, hi in zip(starts, stops, strict=True):
        if lo >= n:
            continue
        out.append(raw[at : words.start[lo]])
        at = int(words.start[hi]) if hi < n else len(raw)
    return b"".join([*out, raw[at:]]).decode()


def removed(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """The same rows and columns with the removal intervals cut from ``text``.

    A text of which nothing is left is dropped, as all of it is in other documents; ``n_chars``, if
    there is such a column, follows the text. The intervals are joined by doc_id; they are broadcast
    only where their count, which is taken, is small, and shuffled beyond that.
    """
    names = docs.columns
    at = names.index("text")
    cuts = kept(repeated_intervals(docs, width).where("not first").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("cuts")))
    few = cuts.select(F.sum(F.size("cuts") + 2)).first()[0] or 0
    cuts = cuts.withColumnRenamed("doc_id", "cut_id")
    rows = docs.select(F.struct("*").alias("row"))  # columns of any names
    joined = rows.join(F.broadcast(cuts) if few <= BROADCAST_ROWS else cuts, F.col("row.doc_id") == F.col("cut_id"), "left").select("row", "cuts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns, cuts = batch.column("row").flatten(), batch.column("cuts")
            some = np.flatnonzero(cuts.is_valid().to_numpy(zero_copy_only=False))
            keep = np.ones(batch.num_rows, bool)
            if len(some):
                new = columns[at].to_pylist()
                for k in some:
                    if new[k] is not None:
                        c = cuts[int(k)].as_py()
                        new[k] = _cut(new[k], [x["start"] for x in c], [x["stop"] for x in c])
                        keep[k] = bool(new[k].strip())
                columns[at] = pa.array(new, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names).filter(pa.array(keep))

    out = joined.mapInArrow(run, docs.schema)
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def op8_substring_dedup(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return repeated_intervals(table(spark, sf_dir, "documents"))


OP8_SQL = f"""
WITH toks AS (SELECT DISTINCT doc_id, regexp_extract_all(text, '[^\\t\\n\\f\\r ]+') w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
win AS (SELECT DISTINCT doc_id, p, md5(array_to_string(w[p + 1 : p + {WIDTH}], ' ')) h
        FROM (SELECT doc_id, w, unnest(range(0, len(w) - {WIDTH} + 1)) p FROM toks WHERE len(w) >= {WIDTH})),
rep AS (SELECT doc_id, p, row_number() OVER (PARTITION BY h ORDER BY doc_id, p) = 1 AS first FROM win QUALIFY count(*) OVER (PARTITION BY h) > 1),
cut AS (SELECT *, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id, first ORDER BY p) <= {WIDTH} THEN 0 ELSE 1 END b FROM rep),
grp AS (SELECT *, sum(b) OVER (PARTITION BY doc_id, first ORDER BY p) g FROM cut)
SELECT doc_id, first, CAST(min(p) AS BIGINT) AS start, CAST(max(p) + {WIDTH} AS BIGINT) AS stop FROM grp GROUP BY doc_id, first, g
"""
