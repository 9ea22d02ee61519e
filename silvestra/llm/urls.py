"""URL filters: a cascade of Bloom filters with exact membership over the corpus's own keys.

A key is a normalised URL: lower case, without scheme, ``www.`` or ``m.``, fragment, query, trailing
slash or index page. The universe is every key of the corpus; a listed key is one of the universe
that is on the list. Keys fall into shards by hash. In a shard the first filter holds the listed
keys; the second those other keys that the first takes for listed; the third those listed keys that
the second takes for the others; and so on until a filter makes no mistake on the universe. A key is
then listed if it passes an odd number of filters before one turns it away, and this is exact for
every key of the universe.

Only 16 bytes a key travel when the cascade is built, each shard in one task. The finished cascade,
a few bits a key, is broadcast where its measured size is at most ``BROADCAST_BYTES``, and pages are
then filtered without an exchange; beyond that, keys meet their shard's filters in one exchange.

Defined results: a null or empty URL has no key and isn't listed; pages that share a key share its
verdict; list entries that no page has do nothing; an empty list or corpus gives an empty cascade,
by which nothing is listed. A key that isn't of the universe gets an approximate answer. Extra
columns of any name are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import kept, table

#: Names that put a host on the list of the registered query, wherever they stand between its dots.
LISTED_NAMES = ("spam-farm", "casino-win", "free-bets", "ads-track", "cheap-pills", "adult-x")
SHARD_KEYS = 200_000
BROADCAST_BYTES = 64 << 20
FIRST_RATE, NEXT_RATE = 0.05, 0.3


def url_key(url: Column) -> Column:
    """The normalised key; null where nothing is left."""
    key = F.regexp_replace(F.lower(F.trim(url)), r"^[a-z][a-z0-9+.\-]*://", "")
    key = F.regexp_replace(F.regexp_replace(key, r"[?#].*$", ""), r"^(www|m)\.", "")
    key = F.regexp_replace(F.regexp_replace(key, r"/index\.[a-z]+$", ""), r"/+$", "")
    return F.when(key != "", key)


def host_of(key: Column) -> Column:
    return F.regexp_extract(key, r"^([^/:]*)", 1)


def with_names(key: Column, names: tuple[str, ...]) -> Column:
    """Whether one of these stands between the dots of the key's host."""
    return F.coalesce(F.arrays_overlap(F.split(host_of(key), r"\."), F.array(*map(F.lit, names)).cast("array<string>")), F.lit(False))


def _hashes(key: Column) -> list[Column]:
    return [F.xxhash64(F.lit(11), key), F.xxhash64(F.lit(23), key)]


def _places(a: np.ndarray, b: np.ndarray, bits: int, k: int, level: int) -> np.ndarray:
    """The k bits of each key in a filter; levels use different ones."""
    step = (b + np.uint64((2 * level + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) | np.uint64(1)
    start = a + np.uint64(level * 0xD1342543DE82EF95 % (1 << 64))
    return ((start[:, None] + np.arange(k, dtype=np.uint64) * step[:, None]) >> np.uint64(20)) % np.uint64(bits)


def _filter(a: np.ndarray, b: np.ndarray, rate: float, level: int) -> tuple[int, int, np.ndarray]:
    bits = max(64, int(np.ceil(len(a) * np.log(1 / rate) / np.log(2) ** 2 / 8)) * 8)
    k = max(1, round(bits / max(1, len(a)) * np.log(2)))
    k = min(k, 16)
    made = np.zeros(bits, bool)
    made[_places(a, b, bits, k, level).ravel()] = True
    return bits, k, np.packbits(made)


def _passes(level: int, bits: int, k: int, made: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    at = _places(a, b, bits, k, level)
    return ((made[at >> np.uint64(3)] >> (7 - (at & np.uint64(7))).astype(np.uint8)) & 1).all(axis=1)


def cascade(listed: np.ndarray, others: np.ndarray) -> bytes:
    """Filters for the keys (rows of two hashes) listed and not listed; exact on both."""
    parts, inside, outside, level = [], listed, others, 0
    while len(inside):
        bits, k, made = _filter(inside[:, 0], inside[:, 1], FIRST_RATE if level == 0 else NEXT_RATE, level)
        parts.append(np.array([bits, k], np.uint64).tobytes() + made.tobytes())
        wrong = outside[_passes(level, bits, k, made, outside[:, 0], outside[:, 1])] if len(outside) else outside
        inside, outside, level = wrong, inside, level + 1
    return b"".join(parts)


def listed_by(raw: bytes, keys: np.ndarray) -> np.ndarray:
    """The cascade's verdict on each key."""
    out, live, at, level = np.zeros(len(keys), bool), np.arange(len(keys)), 0, 0
    while at < len(raw) and len(live):
        bits, k = (int(x) for x in np.frombuffer(raw, np.uint64, 2, at))
        made = np.frombuffer(raw, np.uint8, bits // 8, at + 16)
        live = live[_passes(level, bits, k, made, keys[live, 0], keys[live, 1])]
        out[live] = level % 2 == 0
        at, level = at + 16 + bits // 8, level + 1
    return out


def _build(group: pa.Table) -> pa.Table:
    keys = np.stack([group[c].to_numpy().view(np.uint64) for c in ("a", "b")], 1)
    on = group["listed"].to_numpy(zero_copy_only=False).astype(bool)
    both, place = np.unique(keys, axis=0, return_inverse=True)
    listed = np.bincount(place.ravel(), on, len(both)) > 0
    return pa.table([group["shard"].slice(0, 1), pa.array([cascade(both[listed], both[~listed])], pa.binary())], ["shard", "filters"])


def build_cascade(keys: DataFrame) -> tuple[DataFrame, int]:
    """(shard, filters) of the keys (key, listed), and the number of shards. Keys may repeat; one listed row lists a key."""
    a, b = _hashes(F.col("key"))
    rows = keys.where("key is not null").select(a.alias("a"), b.alias("b"), F.col("listed").alias("on")).groupBy("a", "b").agg(F.max("on").alias("listed"))
    rows = kept(rows)
    shards = max(1, -(-rows.count() // SHARD_KEYS))
    sharded = rows.withColumn("shard", F.pmod(F.col("a"), F.lit(shards)).cast("int"))
    return kept(sharded.groupBy("shard").applyInArrow(_build, "shard int, filters binary")), shards


def _verdicts(batch: pa.RecordBatch, filters: dict[int, bytes]) -> pa.RecordBatch:
    valid = batch.column("key").is_valid().to_numpy(zero_copy_only=False)
    keys = np.stack([batch.column(c).to_numpy().view(np.uint64) for c in ("a", "b")], 1)
    shard = batch.column("shard").to_numpy()
    out = np.zeros(batch.num_rows, bool)
    for s in np.unique(shard):
        own = np.flatnonzero(valid & (shard == s))
        out[own] = listed_by(filters.get(int(s), b""), keys[own])
    return pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("key"), pa.array(out)], ["page_id", "url_key", "listed"])


def judged(pages: DataFrame, filters: DataFrame, shards: int) -> DataFrame:
    """page_id, url_key, listed of every row."""
    a, b = _hashes(F.col("key"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), url_key(F.col("url")).alias("key")).select("page_id", "key", a.alias("a"), b.alias("b")).withColumn("shard", F.pmod(F.col("a"), F.lit(shards)).cast("int"))
    kind = "page_id long, url_key string, listed boolean"
    if (filters.agg(F.sum(F.octet_length("filters"))).first()[0] or 0) <= BROADCAST_BYTES:
        shared = pages.sparkSession.sparkContext.broadcast({r["shard"]: bytes(r["filters"]) for r in filters.toLocalIterator()})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield _verdicts(batch, shared.value)

        return rows.mapInArrow(run, kind)

    def meet(own: pa.Table, of: pa.Table) -> pa.Table:
        made = {s: f.as_py() for s, f in zip(of["shard"].to_pylist(), of["filters"], strict=True)}
        return pa.Table.from_batches([_verdicts(x, made) for x in own.combine_chunks().to_batches()], pa.schema([("page_id", pa.int64()), ("url_key", own.schema.field("key").type), ("listed", pa.bool_())]))

    return rows.groupBy("shard").cogroup(filters.groupBy("shard")).applyInArrow(meet, kind)


def filtered(pages: DataFrame, names: tuple[str, ...] = LISTED_NAMES) -> DataFrame:
    """The verdict on every page by the list of all keys with hosts of these names."""
    keys = pages.select(url_key(F.col("url")).alias("key")).where("key is not null").distinct()
    return judged(pages, *build_cascade(keys.withColumn("listed", with_names(F.col("key"), names))))


def filtered_by(pages: DataFrame, listed: DataFrame) -> DataFrame:
    """The verdict on every page by a table of listed URLs (``url``), which meets the pages' keys once, when the cascade is built."""
    keys = pages.select(url_key(F.col("url")).alias("key")).where("key is not null").distinct()
    on = listed.select(url_key(F.col("url")).alias("of")).where("of is not null").distinct()
    return judged(pages, *build_cascade(keys.join(on, F.col("key") == F.col("of"), "left").select("key", F.col("of").isNotNull().alias("listed"))))


def op6_url_filter(spark, sf_dir: str) -> DataFrame:
    return filtered(table(spark, sf_dir, "pages"))


_NAMES = ", ".join(f"'{n}'" for n in LISTED_NAMES)
OP6_SQL = rf"""
WITH k AS (SELECT page_id, nullif(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(url)),
    '^[a-z][a-z0-9+.\-]*://', ''), '[?#].*$', ''), '^(www|m)\.', ''), '/index\.[a-z]+$', ''), '/+$', ''), '') url_key FROM pages),
h AS (SELECT *, regexp_extract(url_key, '^([^/:]*)', 1) h FROM k)
SELECT page_id, url_key, coalesce(list_has_any(string_split(h, '.'), [{_NAMES}]), false) AS listed FROM h
"""
