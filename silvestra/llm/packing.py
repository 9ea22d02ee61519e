"""Order-preserving packing by dynamic programming.

Documents follow one another by doc_id. Windows of at most ``length`` tokens are cut only after a
document or a sentence; the cuts minimise the sum of padding (tokens that a window lacks) and of
penalties for documents cut in two. With S the running number of tokens and f the least cost of what
lies before a cut, f(j) = penalty(j) + length - S(j) + min(f(i) + S(i)) over cuts i of at most
``length`` tokens before j; a monotone queue keeps that minimum, so the time is linear.

Work is split into shards of ``SHARD_TOKENS`` in the order of documents, by exact running numbers of
tokens, whatever the ids are; each is packed on its own. Only lengths of sentences are exchanged, never
texts.

Defined results: tokens are runs of non-space bytes; a sentence ends with a token that ends in
``. ! ?`` or before a line break. A sentence longer than a window is cut after each ``length`` tokens
at ``HARD`` penalty, nothing is dropped. Texts that are null or without tokens are in no window. Rows
with a null doc_id come first. Rows that share a doc_id follow one another by a hash of their
text, and each keeps its own span. Of equally cheap cuts the earliest window start is taken.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import kept, table
from .tokens import Words, chunks

LENGTH, SENTENCE, HARD = 2048, 32, 256
SHARD_TOKENS = 2_000_000
_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in ".!?"]] = True
RESULT = "shard long, window int, doc_ids array<long>, starts array<int>, stops array<int>, n_tokens int, padding int"


def _sentences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each row with tokens: their number, the sentences' lengths, and a hash to order by."""
    for batch in chunks(batches):
        words = Words(batch.column("text"), lower=False)
        n = len(words.start)
        if not n:
            continue
        lines = np.r_[0, np.cumsum(words.raw == 10)]
        last = _ENDS[words.raw[words.end - 1]]
        last[:-1] |= lines[words.start[1:]] > lines[words.end[:-1]]
        filled = words.bounds[1:] > words.bounds[:-1]
        last[words.bounds[1:][filled] - 1] = True
        stops = np.flatnonzero(last) + 1
        lengths = np.diff(np.r_[0, stops]).astype(np.uint32)
        ends = np.searchsorted(stops, words.bounds, "right")
        rows = np.flatnonzero(filled)
        tie = np.add.reduceat(words.hash, words.bounds[:-1][filled]).view(np.int64)
        counts = np.diff(words.bounds)[rows]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").take(pa.array(rows)), pa.array(tie), pa.array(counts.astype(np.int64)), pa.array([lengths[ends[k] : ends[k + 1]].tobytes() for k in rows], pa.binary())],
            ["doc_id", "tie", "n_tokens", "lengths"],
        )


def cuts(sizes: list[int], penalties: list[int], length: int) -> list[int]:
    """After which pieces to cut: of all cuts with windows of at most ``length``, the cheapest."""
    cost, upto, back = [0] * (len(sizes) + 1), [0] * (len(sizes) + 1), [0] * (len(sizes) + 1)
    queue: deque[int] = deque()  # f(i) + S(i) ascends along it
    total = 0
    for j, (size, penalty) in enumerate(zip(sizes, penalties, strict=True), 1):
        i = j - 1
        value = cost[i] + total
        while queue and cost[queue[-1]] + upto[queue[-1]] > value:
            queue.pop()
        queue.append(i)
        total += size
        upto[j] = total
        while total - upto[queue[0]] > length:
            queue.popleft()
        i = queue[0]
        back[j] = i
        cost[j] = penalty + length - total + upto[i] + cost[i]
    out, j = [], len(sizes)
    while j:
        out.append(j)
        j = back[j]
    return out[::-1]


def _pieces(lengths: np.ndarray, length: int, sentence: int, hard: int) -> tuple[np.ndarray, np.ndarray]:
    """A document's pieces and the penalty of a cut after each."""
    lengths = lengths.astype(np.int64)
    parts = -(-lengths // length)
    if (parts > 1).any():
        sizes = np.full(parts.sum(), length, np.int64)
        ends = np.cumsum(parts) - 1
        sizes[ends] = lengths - (parts - 1) * length
        penalties = np.full(len(sizes), hard)
        penalties[ends] = sentence
    else:
        sizes, penalties = lengths, np.full(len(lengths), sentence)
    penalties[-1] = 0
    return sizes, penalties


def _pack(length: int, sentence: int, hard: int):
    def run(shard: pa.Table) -> pa.Table:
        shard = shard.sort_by([("doc_id", "ascending"), ("tie", "ascending")])
        null = shard["doc_id"].is_null().to_numpy() if shard["doc_id"].null_count else np.zeros(len(shard), bool)
        shard = shard.take(pa.array(np.r_[np.flatnonzero(null), np.flatnonzero(~null)]))
        ids = shard["doc_id"].to_pylist()
        made = [_pieces(np.frombuffer(x.as_py(), np.uint32), length, sentence, hard) for x in shard["lengths"]]
        sizes = np.concatenate([x[0] for x in made])
        owner = np.repeat(np.arange(len(made)), [len(x[0]) for x in made])
        upto = np.r_[0, np.cumsum(sizes)]
        begins = upto[np.searchsorted(owner, np.arange(len(made)))]
        ends = np.r_[begins[1:], upto[-1]]
        out: list[list] = [[], [], [], [], [], []]
        i = 0
        for k, j in enumerate(cuts(sizes.tolist(), np.concatenate([x[1] for x in made]).tolist(), length)):
            lo, hi = int(upto[i]), int(upto[j])
            docs = range(owner[i], owner[j - 1] + 1)
            for x, v in zip(out, (k, [ids[d] for d in docs], [max(0, lo - int(begins[d])) for d in docs], [min(hi, int(ends[d])) - int(begins[d]) for d in docs], hi - lo, length - hi + lo), strict=True):
                x.append(v)
            i = j
        shards = pa.array([shard["shard"][0].as_py()] * len(out[0]), pa.int64())
        kinds = (pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int32(), pa.int32())
        return pa.table([shards, *(pa.array(x, t) for x, t in zip(out, kinds, strict=True))], ["shard", "window", "doc_ids", "starts", "stops", "n_tokens", "padding"])

    return run


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of an ordered partition with the number of its tokens up to each."""
    total = 0
    for batch in batches:
        upto = total + np.cumsum(batch.column("n_tokens").to_numpy())
        total = int(upto[-1]) if len(upto) else total
        yield pa.RecordBatch.from_arrays([batch.column("part"), pa.array(upto), *(batch.column(c) for c in ("doc_id", "tie", "lengths"))], ["part", "upto", "doc_id", "tie", "lengths"])


def packed(docs: DataFrame, length: int = LENGTH, sentence: int = SENTENCE, hard: int = HARD, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Windows: shard, number within it, and for each the spans (doc_ids, starts, stops in tokens)."""
    rows = kept(docs.select(F.col("doc_id").cast("long"), "text").where("text is not null").mapInArrow(_sentences, "doc_id long, tie long, n_tokens long, lengths binary"))
    ordered = rows.withColumn("number", F.monotonically_increasing_id()).orderBy(F.asc_nulls_first("doc_id"), "tie", "number").withColumn("part", F.spark_partition_id())
    ordered = kept(ordered.mapInArrow(_running, "part int, upto long, doc_id long, tie long, lengths binary"))
    sums = ordered.groupBy(F.col("part").alias("of")).agg(F.max("upto").alias("n"))  # one row a partition
    before = sums.select("of", (F.sum("n").over(W.orderBy("of")) - F.col("n")).alias("before"))
    sharded = ordered.join(F.broadcast(before), F.col("part") == F.col("of")).withColumn("shard", F.floor((F.col("before") + F.col("upto") - 1) / shard_tokens).cast("long"))
    return sharded.select("shard", "doc_id", "tie", "lengths").groupBy("shard").applyInArrow(_pack(length, sentence, hard), RESULT)


def op3_packing(spark, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))
