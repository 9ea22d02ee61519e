"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A document's features are its distinct lower-case words, hashed to ``BUCKETS`` and of joint norm 1,
one bin for each structure statistic, and its hashed lang and source. The machine scores
w0 + sum w_i x_i + sum over i < j of <v_i, v_j> x_i x_j, the pairs in linear time by half the
difference of the square of sums and the sum of squares; the logistic function makes it a probability.

Training takes at most ``LABELLED_ROWS`` labelled documents (the least by a hash of doc_id), whose
features alone reach the driver; scoring takes all documents in one pass without an exchange. Texts
are read whole.

Defined results: an empty or null text has no words, and its statistics are 0; null lang or source is
a value of its own; a doc_id with several labels takes the greatest, and one with several texts teaches the least; without labels of both kinds
each score is the share of good labels, or 1 without any, and all is kept. Rows that repeat are each
scored. Extra columns of any name are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table
from .tokens import Words, chunks, mix

BUCKETS, RANK, LABELLED_ROWS, SEED = 1 << 16, 8, 20_000, 7
EPOCHS, BATCH, RATE, DECAY, SPREAD = 12, 256, 0.1, 1e-5, 0.02
#: A document is kept from this probability on; below 0.5, as a good document lost costs more.
KEEP = 0.3
_BINS = {
    "signs": (0.005, 0.01, 0.02, 0.03, 0.05, 0.08, 0.12, 0.2, 0.3),
    "digits": (0.001, 0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.4),
    "capitals": (0.005, 0.01, 0.02, 0.03, 0.05, 0.1, 0.2, 0.4),
    "not_ascii": (0.001, 0.01, 0.03, 0.06, 0.1, 0.2, 0.4),
    "ends": (0.002, 0.005, 0.01, 0.02, 0.03, 0.05, 0.1),
    "lines": (0.001, 0.002, 0.004, 0.008, 0.015, 0.03, 0.06),
    "word_length": (2, 3, 4, 5, 6, 7, 8, 10, 14),
    "distinct": (0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.85),
    "words": (1, 5, 10, 20, 50, 100, 300, 1000, 4000),
}
_STATISTIC, _META = 0.5, 0.5
_KIND = np.full(256, 5)
_KIND[[*range(ord("a"), ord("z") + 1), 9, 13, 32, ord(","), ord("'"), ord("-")]] = 0
_KIND[[*range(ord("0"), ord("9") + 1)]] = 1
_KIND[[*range(ord("A"), ord("Z") + 1)]] = 2
_KIND[[ord(c) for c in ".!?"]] = 3
_KIND[10] = 4
_KIND[128:] = 6
SIZE = BUCKETS + sum(len(b) + 1 for b in _BINS.values()) + 2 * 1024


def _hashed(column: pa.Array, salt: int) -> np.ndarray:
    """A number below 1024 for each value; 0 stands for null alone."""
    values = column.dictionary_encode()
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    names = Words(values.dictionary.cast(pa.large_string()), lower=False)
    code = np.array([int(mix(np.bitwise_xor.reduce(names.hash[a:b] + np.uint64(salt), initial=np.uint64(salt)).reshape(1))[0] % np.uint64(1023)) + 1 for a, b in zip(names.bounds, names.bounds[1:], strict=False)], np.int64)
    at = pc.fill_null(values.indices.cast(pa.int64()), -1).to_numpy(zero_copy_only=False)
    return np.where(at >= 0, code[np.maximum(at, 0)] if len(code) else 0, 0)


def features(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers and values of all rows, and the bounds of each row's part."""
    words = Words(batch.column("text"), lower=False)
    low = Words(batch.column("text"), lower=True)
    rows = batch.num_rows
    key = np.sort((low.text_of.astype(np.uint64) << np.uint64(16)) | (low.hash & np.uint64(BUCKETS - 1)))
    key = key[np.r_[True, key[1:] != key[:-1]]] if len(key) else key
    owner = (key >> np.uint64(16)).astype(np.int64)
    distinct = np.bincount(owner, minlength=rows)
    counts = np.diff(words.bounds)
    size = np.diff(words.offsets)
    kinds = _KIND[words.raw]
    share = lambda k: np.diff(np.r_[0, np.cumsum(kinds == k)][words.offsets]) / np.maximum(size, 1)
    letters = np.r_[0, np.cumsum(words.end - words.start)]
    stats = {"signs": share(5), "digits": share(1), "capitals": share(2), "not_ascii": share(6), "ends": share(3), "lines": share(4), "word_length": np.diff(letters[words.bounds]) / np.maximum(counts, 1), "distinct": distinct / np.maximum(counts, 1), "words": counts}
    columns, base = [], BUCKETS
    for name, edges in _BINS.items():
        columns.append(base + np.searchsorted(edges, stats[name], "right"))
        base += len(edges) + 1
    columns += [base + _hashed(batch.column("lang"), 1), base + 1024 + _hashed(batch.column("source"), 2)]
    fixed = len(columns)
    bounds = np.r_[0, np.cumsum(distinct + fixed)]
    index, value = np.zeros(bounds[-1], np.int64), np.zeros(bounds[-1], np.float32)
    at = np.arange(len(owner)) + owner * fixed
    index[at] = (key & np.uint64(BUCKETS - 1)).astype(np.int64)
    value[at] = (1 / np.sqrt(np.maximum(distinct, 1)))[owner]
    for k, column in enumerate(columns):
        index[bounds[1:] - fixed + k] = column
        value[bounds[1:] - fixed + k] = _STATISTIC if k < fixed - 2 else _META
    return index, value, bounds


@dataclass
class Machine:
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def parts(self, index: np.ndarray, value: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Raw scores, and what the gradient needs: x v of each feature, and their sums by row."""
        xv = self.factors[index] * value[:, None]
        heads = bounds[:-1]
        sums = np.add.reduceat(xv, heads, axis=0)
        raw = self.bias + np.add.reduceat(self.weights[index] * value, heads) + 0.5 * (np.square(sums).sum(1) - np.add.reduceat(np.square(xv).sum(1), heads))
        return raw, xv, sums

    def probability(self, index: np.ndarray, value: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.parts(index, value, bounds)[0].astype(np.float64), -30, 30)))


def trained(rows: list[tuple[np.ndarray, np.ndarray]], good: np.ndarray, epochs: int = EPOCHS) -> Machine:
    """A machine fitted by Adagrad on the logistic loss, both labels of the same total weight."""
    weights, factors = np.zeros(SIZE, np.float32), np.random.default_rng(SEED).normal(0, SPREAD, (SIZE, RANK)).astype(np.float32)
    share = float(good.mean()) if len(good) else 1.0
    if share in (0.0, 1.0):
        return Machine(30.0 if share else -30.0, weights, factors * 0)
    machine = Machine(0.0, weights, factors)
    importance = np.where(good, 0.5 / share, 0.5 / (1 - share))
    seen_b, seen_w, seen_v = 1e-6, np.full(SIZE, 1e-6, np.float32), np.full((SIZE, RANK), 1e-6, np.float32)
    order, rng = np.arange(len(rows)), np.random.default_rng(SEED + 1)
    for _ in range(epochs):
        rng.shuffle(order)
        for lo in range(0, len(order), BATCH):
            own = order[lo : lo + BATCH]
            index, value = (np.concatenate([rows[k][c] for k in own]) for c in (0, 1))
            bounds = np.r_[0, np.cumsum([len(rows[k][0]) for k in own])]
            raw, xv, sums = machine.parts(index, value, bounds)
            error = (importance[own] * (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - good[own])).astype(np.float32) / len(own)
            each = np.repeat(error, np.diff(bounds))
            touched, place = np.unique(index, return_inverse=True)
            step = each * value
            g = np.bincount(place, step).astype(np.float32) + DECAY * weights[touched]
            seen_w[touched] += g * g
            weights[touched] -= RATE * g / np.sqrt(seen_w[touched])
            pull = step[:, None] * (np.repeat(sums, np.diff(bounds), axis=0) - xv)
            g = np.stack([np.bincount(place, pull[:, f]) for f in range(RANK)], 1).astype(np.float32) + DECAY * factors[touched]
            seen_v[touched] += g * g
            factors[touched] -= RATE * 0.3 * g / np.sqrt(seen_v[touched])
            seen_b += float(error.sum()) ** 2
            machine.bias -= RATE * float(error.sum()) / seen_b**0.5
    return machine


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches):
        index, value, bounds = features(batch)
        parts = [[x[a:b].tobytes() for a, b in zip(bounds, bounds[1:], strict=False)] for x in (index.astype(np.uint32), value)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("good"), *(pa.array(p, pa.binary()) for p in parts)], ["doc_id", "good", "index", "value"])


def machine_for(docs: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS) -> Machine:
    """A machine trained on the labelled documents, ``rows`` labels at most."""
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("__id")).agg((F.max("quality") > 0).alias("good"))
    sample = known.orderBy(F.xxhash64("__id"), "__id").limit(rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string"), F.col("source").cast("string")).join(F.broadcast(sample), F.col("doc_id") == F.col("__id")).drop("__id")
    texts = texts.groupBy("doc_id").agg(F.min(F.struct("text", "lang", "source", "good")).alias("x")).select("doc_id", "x.*")  # one row a label, however often rows repeat
    got = texts.mapInArrow(_examples, "doc_id long, good boolean, index binary, value binary").toArrow().sort_by([("doc_id", "ascending"), ("index", "ascending")])
    examples = [(np.frombuffer(i.as_py(), np.uint32).astype(np.int64), np.frombuffer(v.as_py(), np.float32)) for i, v in zip(got["index"], got["value"], strict=True)]
    return trained(examples, np.array(got["good"].to_pylist(), bool))


def classified(docs: DataFrame, machine: Machine, keep: float = KEEP) -> DataFrame:
    """doc_id, score (the probability of good quality) and keep of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            p = shared.value.probability(*features(batch))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.round(p, 6)), pa.array(p >= keep)], ["doc_id", "score", "keep"])

    return docs.select(F.col("doc_id").cast("long"), "text", F.col("lang").cast("string"), F.col("source").cast("string")).mapInArrow(run, "doc_id long, score double, keep boolean")


def op7_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return classified(docs, machine_for(docs, table(spark, sf_dir, "labels")))
