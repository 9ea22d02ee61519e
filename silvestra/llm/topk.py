"""Exact top-k search by three-phase uniform threshold: a query set against all vectors.

The queries are the vectors whose id is divisible by ``every``; each is compared with all others. The
score of two vectors is their cosine, a sum over ``lists`` blocks of dimensions. Queries and objects
form a grid of cells of bounded size, and each block of dimensions is a list of its own in each cell.

1. Every list gives each query its k best objects by partial score. Their whole scores are resolved
   in the cell; the k-th best over all cells, tau, is a score that k objects are known to reach.
2. The cutoff tau / lists goes to all cells, whose lists collect the objects with at least that partial
   score. An object of score tau or more has one such entry at least, whatever the signs.
3. The scores of the collected objects are resolved in double precision, and the best k are taken.

The partial scores are in single precision; ``SLACK`` covers its error. Scores are compared at 9
digits, ties go to the lower id. What is exchanged are the vectors of the grid, once by phase, and k
scores for each query and cell, never all scores. Nothing is broadcast or sent to the driver.

Defined results: null ids and null vectors, and vectors with null, infinite or NaN elements or of
norm 0 take no part. Rows that repeat an id are one object with the least of the vectors, which is
found before rows meet. A shorter vector counts as padded with zeros. A query has fewer than k rows
if there are fewer other objects. Extra columns of any name are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import kept, table

K, LISTS, EVERY = 10, 2, 20
CHUNK_ROWS, QUERY_ROWS = 8192, 16_384
#: Bytes of the objects of a cell; with fewer objects than for 16 such cells, a cell is a chunk.
CELL_BYTES = 32 << 20
DIGITS, SLACK = 9, 1e-5
_ROWS = 512


def _pack(dims: int, chunk_rows: int):
    """Chunks of so many rows: ids, and the vectors scaled to norm 1."""

    def out(number: int, ids: list[np.ndarray], rows: list[np.ndarray]) -> pa.RecordBatch:
        i, x = np.concatenate(ids), np.concatenate(rows)
        chunk = (TaskContext.get().partitionId() << 32) + number
        return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([len(i)], pa.int32()), pa.array([i.tobytes()], pa.binary()), pa.array([(x / np.linalg.norm(x, axis=1, keepdims=True)).tobytes()], pa.binary())], ["chunk", "n", "ids", "x"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows, held, number = [], [], 0, 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, min(batch.num_rows - at, chunk_rows - held))
                lists = part.column("vector")
                sizes, flat = lists.value_lengths().to_numpy(), lists.flatten().to_numpy(zero_copy_only=False)
                x = np.zeros((len(part), dims))
                x[np.repeat(np.arange(len(part)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
                ids.append(part.column("id").to_numpy())
                rows.append(x)
                at, held = at + len(part), held + len(part)
                if held == chunk_rows:
                    yield out(number, ids, rows)
                    ids, rows, held, number = [], [], 0, number + 1
        if held:
            yield out(number, ids, rows)

    return run


def _asking(every: int):
    """Of each chunk, the rows that are queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, ids, x in zip(batch.column("chunk"), batch.column("ids"), batch.column("x"), strict=True):
                own = np.frombuffer(ids.as_buffer(), np.int64)
                chosen = own % every == 0
                if chosen.any():
                    yield pa.RecordBatch.from_arrays([pa.array([chunk.as_py()], pa.int64()), pa.array([own[chosen].tobytes()], pa.binary()), pa.array([np.frombuffer(x.as_buffer()).reshape(len(own), -1)[chosen].tobytes()], pa.binary())], ["chunk", "ids", "x"])

    return run


def _vectors(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids ascending, and their vectors."""
    ids = np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in rows["ids"]])
    x = np.concatenate([np.frombuffer(x.as_buffer()) for x in rows["x"]]).reshape(len(ids), -1)
    order = np.argsort(ids)
    return ids[order], x[order]


def _best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of each row's k greatest; a bound from some columns spares most of the sort."""
    k, some = min(k, scores.shape[1]), min(scores.shape[1], 1024)
    if k == 0:
        return np.zeros(0, int), np.zeros(0, int)
    if some < k:
        some = scores.shape[1]
    least = np.partition(scores[:, :some], some - k, axis=1)[:, some - k]
    row, col = np.nonzero(scores >= least[:, None])
    order = np.lexsort((-scores[row, col], row))
    row, col = row[order], col[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    return row[rank < k], col[rank < k]


def _entries(queries: pa.Table, objects: pa.Table, edges: np.ndarray, choose) -> Iterator[tuple[np.ndarray, ...]]:
    """Of a cell: (query number, query id, object id, whole score) of what ``choose`` takes from any list."""
    ids, x = _vectors(queries)
    for others, raw in zip(objects["ids"], objects["x"], strict=True):
        own = np.frombuffer(others.as_buffer(), np.int64)
        y = np.frombuffer(raw.as_buffer()).reshape(len(own), -1)
        parts = [np.ascontiguousarray(y[:, a:b], np.float32) for a, b in zip(edges, edges[1:], strict=False)]
        for lo in range(0, len(ids), _ROWS):
            some, found = x[lo : lo + _ROWS], []
            same = np.nonzero(ids[lo : lo + _ROWS, None] == own[None, :]) if len(np.intersect1d(ids[lo : lo + _ROWS], own)) else None
            for (a, b), part in zip(zip(edges, edges[1:], strict=False), parts, strict=True):
                scores = np.ascontiguousarray(some[:, a:b], np.float32) @ part.T
                if same is not None:
                    scores[same] = -np.inf
                q, o = choose(scores, lo)
                real = scores[q, o] > -np.inf
                found.append(q[real] * len(own) + o[real])
            both = np.unique(np.concatenate(found))
            for at in range(0, len(both), 50_000):
                q, o = both[at : at + 50_000] // len(own), both[at : at + 50_000] % len(own)
                yield q + lo, ids[q + lo], own[o], np.round(np.einsum("ij,ij->i", some[q], y[o]), DIGITS)


def _firsts(found: Iterator[tuple[np.ndarray, ...]], k: int) -> tuple[np.ndarray, ...]:
    """Of each query the k best, equal scores by the lower id."""
    held, size = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))], 0

    def merged() -> tuple[np.ndarray, ...]:
        number, q, o, score = (np.concatenate(c) for c in zip(*held, strict=True))
        order = np.lexsort((o, -score, number))
        order = order[np.arange(len(order)) - np.searchsorted(number[order], number[order]) < k]
        return number[order], q[order], o[order], score[order]

    for entry in found:
        held.append(entry)
        size += len(entry[0])
        if size > 1_000_000:
            held, size = [merged()], 0
    return merged()


def _known(edges: np.ndarray, k: int):
    """Phase 1 of a cell: of each query the k best whole scores among the lists' k best."""

    def run(queries: pa.Table, objects: pa.Table) -> pa.Table:
        if not len(queries) or not len(objects):
            return pa.table([pa.array([], pa.int32()), *[pa.array([], pa.binary())] * 2], ["q_chunk", "q", "score"])
        _, q, _, score = _firsts(_entries(queries, objects, edges, lambda scores, _: _best(scores, k)), k)
        return pa.table([queries["q_chunk"].slice(0, 1), pa.array([q.tobytes()], pa.binary()), pa.array([score.tobytes()], pa.binary())], ["q_chunk", "q", "score"])

    return run


def _cutoff(k: int):
    """tau of each query of a chunk; without k known objects there is none, and all entries count."""

    def run(known: pa.Table) -> pa.Table:
        q, score = (np.concatenate([np.frombuffer(x.as_buffer(), t) for x in known[c]]) for c, t in (("q", np.int64), ("score", np.float64)))
        order = np.lexsort((-score, q))
        q, score = q[order], score[order]
        kth = np.arange(len(q)) - np.searchsorted(q, q) == k - 1
        return pa.table([known["q_chunk"].slice(0, 1), pa.array([q[kth].tobytes()], pa.binary()), pa.array([score[kth].tobytes()], pa.binary())], ["q_chunk", "known", "tau"])

    return run


def _final(edges: np.ndarray, k: int):
    """Phases 2 and 3 of a cell: all entries from the cutoff on, resolved; of each query the k best that reach tau."""

    def run(queries: pa.Table, objects: pa.Table) -> pa.Table:
        number = q = o = np.zeros(0, np.int64)
        score = np.zeros(0)
        if len(queries) and len(objects):
            ids, _ = _vectors(queries)
            tau = np.full(len(ids), -np.inf)
            tau[np.searchsorted(ids, np.frombuffer(queries["known"][0].as_buffer(), np.int64))] = np.frombuffer(queries["tau"][0].as_buffer())
            cut = (tau / (len(edges) - 1) - SLACK).astype(np.float32)
            found = _entries(queries, objects, edges, lambda scores, lo: np.nonzero(scores >= cut[lo : lo + _ROWS, None]))
            good = ((e, e[3] >= tau[e[0]]) for e in found)
            number, q, o, score = _firsts((tuple(c[g] for c in e) for e, g in good), k)
        return pa.table([pa.array(q), pa.array(o), pa.array(score)], ["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY, lists: int = LISTS, chunk_rows: int = CHUNK_ROWS, query_rows: int = QUERY_ROWS, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id and score (9 digits) of the k best others of each vector with an id divisible by ``every``."""
    finite = F.forall("vector", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    rows = vectors.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.col(f"`{vector_column}`").cast("array<double>").alias("vector"))
    rows = rows.where(F.col("id").isNotNull() & F.col("vector").isNotNull()).where(finite & F.exists("vector", lambda e: e != 0))
    dims = rows.agg(F.max(F.size("vector"))).first()[0] or 1
    lists = max(1, min(lists, dims))
    objects = kept(rows.groupBy("id").agg(F.min("vector").alias("vector")).mapInArrow(_pack(dims, chunk_rows), "chunk long, n int, ids binary, x binary"))
    n, chunks = objects.agg(F.sum("n"), F.count("*")).first()
    cells = max(1, min(chunks, 16), -(-(n or 0) * dims * 8 // CELL_BYTES))
    asking = kept(objects.mapInArrow(_asking(every), "chunk long, ids binary, x binary"))
    q_chunks = max(1, -(-int(asking.agg(F.sum(F.octet_length("ids"))).first()[0] or 0) // 8 // query_rows))
    asking = asking.select(F.pmod(F.xxhash64("chunk"), F.lit(q_chunks)).cast("int").alias("q_chunk"), "ids", "x")
    edges = np.linspace(0, dims, lists + 1).astype(int)
    cell = lambda most: F.explode(F.sequence(F.lit(0), F.lit(most - 1)))
    asked = objects.select(cell(q_chunks).alias("for"), F.pmod(F.xxhash64("chunk", F.lit(7)), F.lit(cells)).cast("int").alias("place"), "ids", "x")

    known = asking.withColumn("cell", cell(cells)).groupBy("q_chunk", "cell").cogroup(asked.groupBy("for", "place")).applyInArrow(_known(edges, k), "q_chunk int, q binary, score binary")
    taus = kept(known.groupBy("q_chunk").applyInArrow(_cutoff(k), "q_chunk int, known binary, tau binary"))
    told = asking.join(taus, "q_chunk").withColumn("cell", cell(cells))
    found = told.groupBy("q_chunk", "cell").cogroup(asked.groupBy("for", "place")).applyInArrow(_final(edges, k), "query_id long, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_exact_topk(spark, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


OP1_SQL = f"""
WITH v AS (SELECT vec_id, min(list_transform(embedding, lambda x: x::DOUBLE)) e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY vec_id),
s AS (SELECT a.vec_id q, b.vec_id o, round(list_inner_product(a.e, b.e) / sqrt(list_inner_product(a.e, a.e) * list_inner_product(b.e, b.e)), {DIGITS}) s FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % {EVERY} = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s DESC, o) r FROM s)
SELECT q AS query_id, CAST(r AS INT) AS rank, o AS vec_id, s AS score FROM r WHERE r <= {K}
"""
