"""Quality rules by n-gram perplexity: a modified Kneser-Ney bigram model counted in Spark.

Words are lower-case runs of non-space bytes, each named by 48 bits of its hash. All words and bigrams
of all texts are counted; nothing is capped, sampled or pruned by size, and nothing that grows with
the corpus is broadcast or sent to the driver. The model is never in one place:

1. Texts become chunks of tokens: a sorted array of the chunk's words, and for each token the rank of
   its word there. This table is written once; texts aren't read again.
2. Each chunk sends the hashes of its bigrams, sorted and delta-coded, with their counts to buckets by
   hash. A bucket is a sorted hash array of all bigrams that fall there: it counts each over all chunks
   and answers each chunk in the order in which it asked. One of the chunks that have a bigram owns it.
3. Each chunk adds up, by word, what it owns: tokens that follow, bigrams by count, types that the word
   ends. These sums meet by word in buckets, which answer each chunk that has the word in the same way.
4. Answers are written by chunk, and each chunk is scored with its own answers only.

A hot word or bigram is one entry of a chunk, so nothing gathers where it is counted. Work, exchange and answers grow in proportion to the corpus.

P(w | v) = (c(vw) - D(c(vw))) / c(v) + g(v) Pc(w), with the discounts D1, D2, D3+ from the counts of
counts, g(v) the mass that is left, and Pc the discounted share of bigram types that end in w,
interpolated with the uniform distribution. A bigram that occurs once is counted, but as it is known
from the judged text alone, all of its mass goes to the lower order. A document's perplexity is exp of
its mean -ln P, the first word following a start symbol.

Each language has a band of ln perplexity: from ``LOW`` times its median, which copied texts keep above
and endless repetition doesn't, to ``HIGH`` scaled median deviations above the median. Both ends give
way by ``NOISE`` over the root of the number of words, as short texts vary more by chance. Documents
outside are rejected.

Defined results: null or empty texts have no perplexity and are kept (other rules judge them); a
null lang is a language of its own; rows that repeat count as often as they occur; without any word
nothing is rejected. Extra columns of any name are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..store import deleted, released
from .common import buckets_for, kept, stored, table, text_bytes
from .tokens import Words, chunks, mix, planes, squeezed, unplaned, unsqueezed

LOW, HIGH, NOISE = 0.3, 1.8, 6.0
#: Tokens of a chunk; a longer text is a chunk of its own.
CHUNK_TOKENS = 2_200_000
#: Chunks of which the answers share a folder.
_FOLDER = 16
_WORD = np.uint64((1 << 48) - 1)
_START = np.uint64(0)
#: Bits of a bigram's hash within its bucket. Buckets hold some 2.5 million bigrams at any size, of which one in
#: 27,000 shares its hash with another.
_BITS = np.uint64(36)
_CODED = "chunk long, doc_ids array<long>, langs array<string>, sizes binary, words binary, ranks binary, tokens binary"
_ROWS = "kind int, chunk long, bucket int, a binary, b binary"


def packed(keys: np.ndarray) -> bytes:
    """Ascending keys as differences, byte by byte in planes, so that compression finds the zeros."""
    return planes(np.diff(keys.astype(np.uint64), prepend=np.uint64(0)), 8)


def unpacked(raw: bytes) -> np.ndarray:
    return np.cumsum(unplaned(raw, 8), dtype=np.uint64)


def _heads(*keys: np.ndarray) -> np.ndarray:
    """Where the keys, sorted, change."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    new = np.zeros(len(keys[0]), bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


_SCHEMA = pa.schema([("kind", pa.int32()), ("chunk", pa.int64()), ("bucket", pa.int32()), ("a", pa.binary()), ("b", pa.binary())])
_CODED_SCHEMA = pa.schema([("chunk", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("langs", pa.list_(pa.string())), *((x, pa.binary()) for x in ("sizes", "words", "ranks", "tokens"))])


def _coded(limit: int):
    """Chunks of texts: their words ascending, the words by frequency, and the rank of each token's word."""

    def out(number: int, held: list[tuple]) -> pa.RecordBatch:
        tokens = np.concatenate([h for h, _, _, _ in held])
        words, index = np.unique(tokens, return_inverse=True)
        counts = np.bincount(index, minlength=len(words))
        ranks = np.argsort(-counts, kind="stable")
        place = np.empty(len(words), np.int64)
        place[ranks] = np.arange(len(words))
        sizes = np.concatenate([n for _, n, _, _ in held])
        ids, langs = ([x for part in held for x in part[k].to_pylist()] for k in (2, 3))
        chunk = (TaskContext.get().partitionId() << 32) + number
        return _batch(_CODED_SCHEMA, [(chunk, ids, langs, planes(sizes, 4), packed(words), planes(ranks, 4), planes(place[index], 4))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, number = [], 0, 0
        for batch in chunks(batches):
            words = Words(batch.column("text"), lower=True)
            held.append((np.maximum(words.hash & _WORD, np.uint64(1)), np.diff(words.bounds), batch.column("doc_id"), batch.column("lang")))
            size += len(words.hash)
            if size >= limit:
                yield out(number, held)
                held, size, number = [], 0, number + 1
        if held:
            yield out(number, held)

    return run


class _Chunk:
    """A chunk's words (the start symbol first), its bigrams by bucket and hash, and the bounds of buckets in both."""

    def __init__(self, row: dict, n_buckets: int) -> None:
        self.words = np.r_[_START, unpacked(row["words"].as_py())]
        ranks, tokens = unplaned(row["ranks"].as_py(), 4), unplaned(row["tokens"].as_py(), 4)
        self.sizes = unplaned(row["sizes"].as_py(), 4).astype(np.int64)
        w = (ranks + np.uint64(1)).astype(np.uint32)[tokens] if len(tokens) else np.zeros(0, np.uint32)
        v = np.r_[np.zeros(min(1, len(w)), np.uint32), w[:-1]]
        v[(np.cumsum(self.sizes) - self.sizes)[self.sizes > 0]] = 0
        self.follow = np.bincount(v, minlength=len(self.words))
        keys = mix(self.words[v] * np.uint64(0x9E3779B97F4A7C15) + self.words[w])
        keys = ((keys >> _BITS) % np.uint64(n_buckets) << _BITS) | (keys & ((np.uint64(1) << _BITS) - np.uint64(1)))
        self.order = np.argsort(keys).astype(np.uint32)
        keys = keys[self.order]
        heads = _heads(keys)
        self.counts, self.keys = np.diff(np.r_[heads, len(keys)]), keys[heads]
        self.v, self.w = v[self.order[heads]], w[self.order[heads]]
        self.bounds = np.searchsorted(self.keys >> _BITS, np.arange(n_buckets + 1).astype(np.uint64))
        home = ((mix(self.words) >> np.uint64(33)) % np.uint64(n_buckets)).astype(np.int64)
        self.names = np.argsort(home, kind="stable")
        self.name_bounds = np.searchsorted(home[self.names], np.arange(n_buckets + 1))


def _rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield {name: batch.column(name)[k] for name in batch.schema.names}


def _asked(n_buckets: int):
    """Of each chunk and bucket, the chunk's bigrams there and their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows_of(batches):
            made, number = _Chunk(row, n_buckets), row["chunk"].as_py()
            at = [slice(made.bounds[b], made.bounds[b + 1]) for b in range(n_buckets)]
            yield _batch(_SCHEMA, [(0, number, b, squeezed(packed(made.keys[x] & ((np.uint64(1) << _BITS) - np.uint64(1)))), squeezed(planes(made.counts[x], 4))) for b, x in enumerate(at) if x.stop > x.start])

    return run


def _pair_bucket(group: pa.Table) -> pa.Table:
    """Counts of a bucket's bigrams over all chunks: of kind 0 for each chunk, twice the counts in the order asked, and 1 where it owns the bigram; 4 the counts of counts."""
    keys, c = [unpacked(unsqueezed(a.as_py())) for a in group["a"]], np.concatenate([unplaned(unsqueezed(b.as_py()), 4).astype(np.int64) for b in group["b"]])
    ends, keys = np.cumsum([len(x) for x in keys]), np.concatenate(keys)
    order = np.argsort(keys, kind="stable")
    heads = _heads(keys[order])
    sums = np.add.reduceat(c[order], heads)
    answer = np.empty(len(order), np.int64)
    answer[order] = np.repeat(sums * 2, np.diff(np.r_[heads, len(order)]))
    answer[order[heads]] += 1
    bucket = group["bucket"][0].as_py()
    rows = [(0, x.as_py(), bucket, squeezed(planes(answer[lo:hi], 6)), b"") for x, lo, hi in zip(group["chunk"], np.r_[0, ends[:-1]], ends, strict=True)]
    rows.append((4, 0, bucket, np.array([(sums == k).sum() for k in (1, 2, 3, 4)], np.int64).tobytes(), b""))
    return pa.Table.from_batches([_batch(_SCHEMA, rows)])


def discounts(n: np.ndarray) -> np.ndarray:
    """D1, D2, D3+ of counts of counts n1 to n4; where these are too few for that, 0.5, 1, 1.5 at most."""
    y = n[0] / (n[0] + 2 * n[1]) if n[0] + 2 * n[1] else 0.5
    d = [k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else k / 2 for k in (1, 2, 3)]
    return np.array([x if 0 < x < k else k / 2 for k, x in zip((1, 2, 3), d, strict=True)])


def _counts(made: _Chunk, chunk: int, path: str, folders: int) -> np.ndarray:
    """Of each bigram of the chunk, what its bucket answered."""
    told, out = _answers(path, chunk_folder(chunk, folders), chunk), np.zeros(len(made.keys), np.int64)
    for b in range(len(made.bounds) - 1):
        at = slice(made.bounds[b], made.bounds[b + 1])
        if at.stop > at.start:
            out[at] = unplaned(unsqueezed(told[b][0]), 6)
    return out


def _shares(path: str, n_buckets: int, folders: int):
    """Of each chunk and bucket: the words at home there, and by word the tokens that follow, of owned bigrams those that occur more than once (tokens, bigrams of 2, bigrams of more), and types that it ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows_of(batches):
            made, number = _Chunk(row, n_buckets), row["chunk"].as_py()
            c = _counts(made, number, path, folders)
            own, c = (c & 1).astype(bool), c >> 1
            n, v = len(made.words), made.v[own]
            by = lambda x: np.bincount(v, np.where(x, 1, 0), n).astype(np.int64)
            sums = [made.follow, np.bincount(v, np.where(c[own] > 1, c[own], 0), n).astype(np.int64), by(c[own] == 2), by(c[own] > 2), np.bincount(made.w[own], minlength=n)]
            rows = []
            for b in range(n_buckets):
                at = made.names[made.name_bounds[b] : made.name_bounds[b + 1]]
                if len(at):
                    rows.append((3, number, b, squeezed(packed(made.words[at])), squeezed(planes(np.concatenate([x[at] for x in sums]), 6))))
            yield _batch(_SCHEMA, rows)

    return run


def _word_bucket(d: np.ndarray):
    """Of the words at home in a bucket: rows of kind 1 for each chunk, with followers, types ended and the mass left; 5 the counts of types ended by 1, 2, 3, 4, 3 or more, their sum, and the words."""

    def run(group: pa.Table) -> pa.Table:
        names = [unpacked(unsqueezed(a.as_py())) for a in group["a"]]
        values = np.concatenate([unplaned(unsqueezed(b.as_py()), 6).reshape(5, -1) for b in group["b"]], axis=1).astype(np.int64)
        ends, names = np.cumsum([len(x) for x in names]), np.concatenate(names)
        order = np.argsort(names, kind="stable")
        heads = _heads(names[order])
        sums = np.add.reduceat(values[:, order], heads, axis=1)
        follow, kept_follow, twice, more, types = sums
        left = np.clip(1 - (kept_follow - d[1] * twice - d[2] * more) / np.maximum(1, follow), 1e-9, 1).astype(np.float32)
        place = np.empty(len(order), np.int64)
        place[order] = np.repeat(np.arange(len(heads)), np.diff(np.r_[heads, len(order)]))
        bucket, rows = group["bucket"][0].as_py(), []
        for x, lo, hi in zip(group["chunk"], np.r_[0, ends[:-1]], ends, strict=True):
            at = place[lo:hi]
            rows.append((1, x.as_py(), bucket, squeezed(planes(np.r_[follow[at], types[at]], 6)), squeezed(planes(left[at].view(np.uint32), 4))))
        rows.append((5, 0, bucket, np.array([*((types == k).sum() for k in (1, 2, 3, 4)), (types > 2).sum(), types.sum(), np.count_nonzero(types)], np.int64).tobytes(), b""))
        return pa.Table.from_batches([_batch(_SCHEMA, rows)])

    return run


def _summed(spark: SparkSession, path: str, kind: int, n: int) -> np.ndarray:
    """The sum of small arrays, one from each bucket."""
    rows = spark.read.schema(_ROWS).parquet(path).where(F.col("kind") == kind).select("a")
    return sum((np.frombuffer(r["a"], np.int64) for r in rows.toLocalIterator()), np.zeros(n, np.int64))


def _answers(path: str, folder: int, chunk: int) -> dict[int, tuple[bytes, bytes]]:
    """What each bucket told this chunk."""
    system, base = fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1) if "://" in path or path.startswith("file:") else f"file://{path}")
    files = [f.path for f in system.get_file_info(fs.FileSelector(f"{base}/folder={folder}", allow_not_found=True)) if f.base_name.endswith(".parquet")]
    out = {}
    for file in files:
        with system.open_input_file(file) as source:
            read = pq.ParquetFile(source)
            at = read.schema_arrow.get_field_index("chunk")
            stats = [read.metadata.row_group(g).column(at).statistics for g in range(read.num_row_groups)]
            groups = [g for g, s in enumerate(stats) if s is None or not s.has_min_max or s.min <= chunk <= s.max]
            for batch in read.iter_batches(batch_size=64, row_groups=groups, columns=["chunk", "bucket", "a", "b"], use_threads=False):
                for k in np.flatnonzero(batch.column("chunk").to_numpy() == chunk):
                    out[batch.column("bucket")[int(k)].as_py()] = batch.column("a")[int(k)].as_py(), batch.column("b")[int(k)].as_py()
    return out


def _scores(pairs: str, words: str, n_buckets: int, folders: int, d: np.ndarray, e: np.ndarray, all_ends: int, spare: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows_of(batches):
            made, chunk = _Chunk(row, n_buckets), row["chunk"].as_py()
            c = _counts(made, chunk, pairs, folders) >> 1
            told = _answers(words, chunk_folder(chunk, folders), chunk)
            follow, ends, left = (np.zeros(len(made.words), t) for t in (np.int64, np.int64, np.float32))
            for b in range(n_buckets):
                at = made.names[made.name_bounds[b] : made.name_bounds[b + 1]]
                if len(at):
                    follow[at], ends[at] = unplaned(unsqueezed(told[b][0]), 6).reshape(2, -1)
                    left[at] = unplaned(unsqueezed(told[b][1]), 4).astype(np.uint32).view(np.float32)
            lower = np.where(ends > 0, ends - e[np.clip(ends, 1, 3) - 1], 0) / all_ends + spare
            share = np.where(c > 1, c - d[np.clip(c, 1, 3) - 1], 0) / np.maximum(1, follow[made.v])
            p = np.log(np.maximum(share + left[made.v] * lower[made.w], 1e-300))
            log_p = np.empty(len(made.order))
            log_p[made.order] = np.repeat(p, made.counts)
            sums, bounds = np.r_[0.0, np.cumsum(log_p)], np.r_[0, np.cumsum(made.sizes)]
            mean = np.where(made.sizes > 0, (sums[bounds[:-1]] - sums[bounds[1:]]) / np.maximum(made.sizes, 1), np.nan)
            yield pa.RecordBatch.from_arrays([row["doc_ids"].values, row["langs"].values, pa.array(made.sizes), pa.array(mean, mask=made.sizes == 0)], ["doc_id", "lang", "n_tokens", "log_ppl"])

    return run


def chunk_folder(chunk: int, folders: int) -> int:
    return ((chunk >> 32) * 31 + (chunk & 0xFFFFFFFF)) % folders


def scored(docs: DataFrame, chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """doc_id, lang, n_tokens, log_ppl of every row, by a model of all of them."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    n_buckets = buckets_for(text_bytes(docs))
    coded = kept(rows.mapInArrow(_coded(chunk_tokens), _CODED), codec="zstd")
    folders = max(1, -(-coded.count() // _FOLDER))
    folder = F.pmod(F.shiftright("chunk", 32) * 31 + F.col("chunk").bitwiseAND(F.lit(0xFFFFFFFF)), F.lit(folders)).cast("int")

    def by_bucket(asked: DataFrame, answer) -> str:
        path = stored(asked.groupBy("bucket").applyInArrow(answer, _ROWS), "kind", codec="zstd")
        released(spark)
        return path

    def by_chunk(path: str, kind: int) -> str:
        """The answers in folders of some chunks each; what they were written to first goes."""
        answers = spark.read.schema(_ROWS).parquet(path).where(F.col("kind") == kind).select("chunk", "bucket", "a", "b").withColumn("folder", folder)
        out = stored(answers.repartition(folders, "folder").sortWithinPartitions("folder", "chunk"), "folder", codec="zstd")
        deleted(spark, path)
        released(spark)
        return out

    counted = by_bucket(coded.mapInArrow(_asked(n_buckets), _ROWS), _pair_bucket)
    d = discounts(_summed(spark, counted, 4, 4))
    pairs = by_chunk(counted, 0)
    told = by_bucket(coded.mapInArrow(_shares(pairs, n_buckets, folders), _ROWS), _word_bucket(d))
    types = _summed(spark, told, 5, 7)
    words = by_chunk(told, 1)
    e, all_ends = discounts(types[:4]), max(1, int(types[5]))
    spare = (1 - (types[5] - e @ types[[0, 1, 4]]) / all_ends) / max(1, int(types[6]))
    return coded.mapInArrow(_scores(pairs, words, n_buckets, folders, d, e, all_ends, spare), "doc_id long, lang string, n_tokens long, log_ppl double")


def bands(scores: DataFrame) -> DataFrame:
    """band_lang, mid, spread: median of ln perplexity and 1.4826 times the median deviation, by language."""
    mid = scores.where("log_ppl is not null").groupBy(F.col("lang").alias("band_lang")).agg(F.percentile_approx("log_ppl", 0.5, 10_000).alias("mid"))
    off = scores.where("log_ppl is not null").join(F.broadcast(mid), F.col("lang").eqNullSafe(F.col("band_lang")))
    return off.groupBy("band_lang").agg(F.first("mid").alias("mid"), (F.percentile_approx(F.abs(F.col("log_ppl") - F.col("mid")), 0.5, 10_000) * 1.4826).alias("spread"))


def judged(docs: DataFrame, low: float = LOW, high: float = HIGH, noise: float = NOISE) -> DataFrame:
    """doc_id, lang, n_tokens, perplexity, keep of every row."""
    scores = kept(scored(docs))
    limits = kept(bands(scores))  # a row a language
    slack = F.lit(noise) / F.sqrt(F.greatest(F.col("n_tokens"), F.lit(1)))
    off = F.col("log_ppl") - F.col("mid")
    keep = F.col("log_ppl").isNull() | ((F.col("log_ppl") >= low * F.col("mid") - slack) & (off <= high * F.col("spread") + slack))
    return scores.join(F.broadcast(limits), F.col("lang").eqNullSafe(F.col("band_lang")), "left").select("doc_id", "lang", "n_tokens", F.round(F.exp("log_ppl"), 4).alias("perplexity"), F.coalesce(keep, F.lit(True)).alias("keep"))


def op10_perplexity_rules(spark, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents"))
