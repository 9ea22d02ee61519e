"""Exact top-k search, n-gram Jaccard join, substring dedup."""

import random
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from silvestra.llm import near, repeats, topk

HARD = [None, "", "   \n", "one", "one", "one two", "ONE two", "word " * 6000]


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


@pytest.mark.parametrize(("lists", "chunk", "asking", "every"), [(2, 64, 1000, 1), (3, 17, 9, 3)])
def test_topk_is_exact(spark, lists, chunk, asking, every):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(90, 12)).astype(np.float32).round(2)
    x[10] = x[11] = x[12]  # ties
    rows = [(int(i), [float(v) for v in r], "k", 1) for i, r in enumerate(x)]
    rows += [rows[5], (7, [9.0] * 12, "k", 1), (500, None, "k", 1), (None, [1.0] * 12, "k", 1), (501, [0.0] * 12, "k", 1), (502, [float("nan")] + [1.0] * 11, "k", 1), (503, [1.0, 2.0], "k", 1), (504, [], "k", 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, chunk string, n int")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.top_k(frame, 4, every, lists, chunk, asking).collect()}
    v = {i: np.array(r, float) for i, r in zip(range(90), x, strict=True)}
    v[503] = np.array([1.0, 2.0] + [0.0] * 10)
    if tuple([9.0] * 12) < tuple(map(float, x[7])):
        v[7] = np.array([9.0] * 12)
    asked = [q for q in v if q % every == 0]
    assert len(got) == 4 * len(asked)
    for q in asked:
        scores = sorted((-round(float(v[q] @ v[o] / np.linalg.norm(v[q]) / np.linalg.norm(v[o])), 9), o) for o in v if o != q)
        for rank in range(1, 5):
            assert got[q, rank][0] == scores[rank - 1][1] and abs(got[q, rank][1] + scores[rank - 1][0]) < 2e-6


def test_topk_of_few(spark):
    frame = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert sorted((r["query_id"], r["vec_id"]) for r in topk.top_k(frame, every=1).collect()) == [(1, 2), (2, 1)]
    assert [(r["query_id"], r["vec_id"]) for r in topk.top_k(frame, every=2).collect()] == [(2, 1)]
    assert topk.top_k(frame).count() == 0
    assert topk.top_k(frame.limit(0)).count() == 0


def sets_of(rows, n=near.N):
    """(doc_id, set of n-grams) of each different text of a document."""
    out = set()
    for i, text in rows:
        if i is not None and text is not None and text.split():
            w = text.lower().split()
            out.add((i, frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1)))))
    return sorted(out, key=lambda x: (x[0], len(x[1])))


def brute_links(rows, t=near.THRESHOLD):
    """Similarity of each pair of different sets, by their least doc_ids."""
    first = {}
    for i, s in sets_of(rows):
        first[s] = min(i, first.get(s, i))
    out = {}
    for a, b in combinations(first, 2):
        s, x, y = len(a & b) / len(a | b), *sorted((first[a], first[b]))
        if s >= t - 1e-9 and x != y:
            out[x, y] = max(round(s, 6), out.get((x, y), 0))
    return out


def brute_groups(rows, t=near.THRESHOLD):
    """doc_id: (least doc_id of what it is connected with, number of links)."""
    sets, label, links = sets_of(rows), {i: i for i, _ in rows if i is not None}, Counter()
    linked = [(i, j) for (i, a), (j, b) in combinations(sets, 2) if i != j and len(a & b) / len(a | b) >= t - 1e-9]
    for i, j in linked:
        links[i] += 1
        links[j] += 1
    while any(label[i] != label[j] for i, j in linked):
        for i, j in linked:
            label[i] = label[j] = min(label[i], label[j])
    return {i: (label[i], links[i]) for i in label}


def near_rows(seed):
    rng = random.Random(seed)
    rows = [(k, t) for k, t in enumerate(HARD)] + [(None, "one two"), (3, "other words here now")]
    base = [words(rng, rng.randint(3, 90)) for _ in range(12)]
    shared = words(rng, 30)
    for k in range(70):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 1 + len(w) // 12)):
            w[rng.randrange(len(w))] = f"w{rng.randrange(400)}"
        rows.append((100 + k, " ".join(w + (shared if rng.random() < 0.3 else []))))
    return [*rows, (100, rows[-1][1]), rows[-1], (101, rows[-2][1]), (101, rows[-2][1] + " end")]


@pytest.mark.parametrize(("paired", "long_list", "group"), [(4096, 2048, 2000), (3, 4, 5)])
def test_near_groups_are_exact(docs_of, monkeypatch, paired, long_list, group):
    monkeypatch.setattr(near, "LONG_LIST", long_list)  # sizes from which work is split
    monkeypatch.setattr(near, "GROUP_PAIRS", group)
    monkeypatch.setattr(near, "_small", near._small if group > 5 else lambda rows: rows)  # nothing is broadcast
    rows = near_rows(paired)
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in near.grouped(docs_of(rows), paired=paired).collect()}
    assert got == brute_groups(rows)
    assert {(r["doc_id_a"], r["doc_id_b"]): r["jaccard"] for r in near.links(docs_of(rows), paired=paired).collect()} == brute_links(rows)


def test_components(spark):
    rng = random.Random(3)
    edges = [(k, k + 1) for k in range(0, 40)] + [(rng.randrange(100, 300), rng.randrange(100, 300)) for _ in range(150)] + [(5, 5), (400, 399)]
    label = {x: x for e in edges for x in e}
    while any(label[a] != label[b] for a, b in edges):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = {r["node"]: r["label"] for r in near.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: v for k, v in label.items() if any(k in e and e[0] != e[1] for e in edges)}
    assert near.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_groups_of_nothing(docs_of):
    assert near.grouped(docs_of([(1, "a")]).limit(0)).count() == 0
    assert [tuple(r) for r in near.grouped(docs_of([(1, None), (1, ""), (None, "a")])).collect()] == [(1, 1, 0)]


def test_near_pieces_of_long_lists_are_all_pairs(monkeypatch):
    """One signature of many sets: the pairs of its pieces are those of the whole list."""
    rng = np.random.default_rng(8)
    key, size, index = rng.integers(1, 1 << 62, 300).astype(np.uint64), rng.integers(5, 15, 300).astype(np.uint32), rng.random(300) < 0.6
    sig = (np.full(300, 77, np.uint64) << np.uint64(1)) | index.astype(np.uint64)
    bucket = pa.table([[key.tobytes()], [size.tobytes()], [np.ones(300, np.uint32).tobytes()], [sig.tobytes()]], ["sets", "sizes", "counts", "sigs"])

    def pairs(long_list):
        monkeypatch.setattr(near, "LONG_LIST", long_list)
        found = near._candidates(0.5)(bucket)
        return {kind: {(r["a"], r["b"], r["n"], r["m"]) for b in near._expanded(0.5)(iter(found.filter(pa.array([k == kind for k in found["kind"].to_pylist()])).to_batches())) for r in b.to_pylist()} for kind in (0, 1)}

    whole, split = pairs(1000), pairs(40)
    assert whole[0] and not whole[1] and split[1] == whole[0] and not split[0]


def test_near_parities_give_a_bound():
    rng = np.random.default_rng(9)
    sets = {k: np.unique(rng.integers(0, 1 << 63, rng.integers(1, 300)).astype(np.uint64)) for k in range(60)}
    for k in range(0, 60, 2):
        sets[k + 1] = np.unique(np.r_[sets[k][rng.random(len(sets[k])) < 0.8], sets[k + 1][: rng.integers(0, 60)]])
    sets = {k: v for k, v in sets.items() if len(v)}
    pairs = [(a, b, len(sets[a]), len(sets[b])) for a, b in combinations(sets, 2) if min(len(sets[a]), len(sets[b])) >= 0.5 * max(len(sets[a]), len(sets[b]))]
    table = pa.table([list(c) for c in zip(*pairs, strict=True)], ["a", "b", "n", "m"])
    got = near._bounded(0.5)(table, pa.table([list(sets), pa.array([near._parity(v) for v in sets.values()], pa.binary())], ["set", "grams"]))
    good = {(a, b) for a, b, _, _ in pairs if len(np.intersect1d(sets[a], sets[b])) / len(np.union1d(sets[a], sets[b])) >= 0.5}
    left = set(zip(got["a"].to_pylist(), got["b"].to_pylist(), strict=True))
    assert good and good <= left and len(left) < len(pairs) / 2


def test_near_pairs_of_a_cluster_take_less_than_a_byte():
    rng = np.random.default_rng(10)
    names = np.sort(rng.integers(1, 1 << 62, 300).astype(np.uint64))
    i, j = np.triu_indices(300, 1)
    sizes = rng.integers(5, 15, 300).astype(np.uint32)
    rows = [near._packed_pairs(np.full(x.sum(), 7), names[i[x]], names[j[x]], sizes[i[x]], sizes[j[x]]) for x in (i < 200, i > 100)]
    made = near._merged(pa.Table.from_batches(rows))
    ((got, n, a, b),) = near._unpacked(made)
    assert (got == names).all() and (n == sizes).all() and (a == i).all() and (b == j).all()
    assert made.column("block").to_pylist() == [7] and len(made["codes"][0].as_py()) < len(i) / 10


def test_near_writes_no_row_a_pair(docs_of, monkeypatch):
    """A cluster of different near copies: what is written grows with the sets, not with their pairs."""
    rng, written, kept, stored = random.Random(12), [], near.kept, near.stored
    text = words(rng, 60)
    rows = [(k, " ".join([*text, f"own{k}"])) for k in range(80)]
    monkeypatch.setattr(near, "kept", lambda df, *by, **k: (out := kept(df, *by, **k), written.append(out.count()))[0])

    def counted(df, *by, **k):
        path = stored(df, *by, **k)
        written.append(df.sparkSession.read.parquet(path).count())
        return path

    monkeypatch.setattr(near, "stored", counted)
    got = {tuple(r) for r in near.grouped(docs_of(rows)).collect()}
    assert got == {(k, 0, 79) for k in range(80)}
    assert written and max(written) < 80 * 79 / 4


def test_near_counts_links_of_a_cluster_without_listing_its_pairs(docs_of, monkeypatch):
    rng, listed, kept = random.Random(13), [], near.kept
    text = words(rng, 60)
    rows = [(k, " ".join([*text, f"own{k}"])) for k in range(80)]

    def counted(df, *by, **k):
        out = kept(df, *by, **k)
        if "codes" in out.columns:
            listed.append(sum(len(i) for _, _, i, _ in near._unpacked(out.toArrow())))
        return out

    monkeypatch.setattr(near, "kept", counted)
    assert {tuple(r) for r in near.grouped(docs_of(rows)).collect()} == {(k, 0, 79) for k in range(80)}
    assert listed and max(listed) <= near.STARS * 79


@pytest.mark.parametrize(("sets", "round_", "cells", "dense", "stars"), [(8192, 2, 4 << 20, 64, 8), (4, 1, 7, 1, 3)])
def test_near_links_within_known_classes_are_exact(docs_of, monkeypatch, sets, round_, cells, dense, stars):
    for name, value in (("PART_SETS", sets), ("ROUND", round_), ("_CELLS", cells), ("_MATRIX_BYTES", cells * 8), ("_DENSE", dense), ("STARS", stars)):
        monkeypatch.setattr(near, name, value)
    rows = near_rows(sets)
    rows += [(100, rows[20][1]), (90, rows[20][1]), (90, rows[21][1]), (91, rows[21][1]), (91, rows[22][1]), (91, rows[40][1])]  # several sets a document
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in near.grouped(docs_of(rows)).collect()}
    assert got == brute_groups(rows)


def test_near_common_counts(monkeypatch):
    rng = np.random.default_rng(14)
    monkeypatch.setattr(near, "_CELLS", 100)
    monkeypatch.setattr(near, "_MATRIX_BYTES", 500)
    a, b = ([np.unique(rng.integers(0, 60, rng.integers(1, 40)) ** 2).astype(np.uint64) for _ in range(k)] for k in (30, 47))
    for dense in (1, 3, 1000):
        monkeypatch.setattr(near, "_DENSE", dense)
        got = np.concatenate([x for _, x in near._common(a, b)])
        assert (got == [[len(np.intersect1d(x, y)) for y in b] for x in a]).all()


@pytest.mark.parametrize(("paired", "long_list", "group", "stars"), [(4096, 2048, 2000, 8), (3, 2, 5, 1)])
def test_near_classes_are_exact(docs_of, monkeypatch, paired, long_list, group, stars):
    for name, value in (("LONG_LIST", long_list), ("GROUP_PAIRS", group), ("STARS", stars)):
        monkeypatch.setattr(near, name, value)
    monkeypatch.setattr(near, "_small", near._small if group > 5 else lambda rows: rows)
    rows = near_rows(paired + 1)
    got = {r["doc_id"]: r["class_id"] for r in near.classes(docs_of(rows), paired=paired).collect()}
    assert got == {k: c for k, (c, _) in brute_groups(rows).items()}


def test_near_classes_of_nothing(docs_of):
    assert near.classes(docs_of([(1, "a")]).limit(0)).count() == 0
    assert [tuple(r) for r in near.classes(docs_of([(1, None), (1, ""), (None, "a")])).collect()] == [(1, 1)]


@pytest.mark.parametrize("long_list", [1000, 6])
def test_near_lists_give_the_pairs_of_different_labels(monkeypatch, long_list):
    rng = np.random.default_rng(11)
    monkeypatch.setattr(near, "LONG_LIST", long_list)
    monkeypatch.setattr(near, "_HELD_PAIRS", 50)
    key, size = np.arange(1, 121).astype(np.uint64) << np.uint64(40), rng.integers(5, 15, 120).astype(np.uint32)
    label = np.where(rng.random(120) < 0.6, 3, rng.integers(4, 9, 120))
    label[:20] = 3
    lists = {77: np.arange(20), 78: np.arange(120), 79: np.arange(40, 60), 80: np.arange(15, 30)}  # the first is of one label
    of = np.r_[tuple(lists.values())]
    index = rng.random(len(of)) < 0.6
    sig = np.repeat([*lists], [len(x) for x in lists.values()]).astype(np.uint64) << np.uint64(1) | index.astype(np.uint64)
    order = np.argsort(of, kind="stable")
    bucket = pa.table([[x.tobytes()] for x in (key, size, np.bincount(of).astype(np.uint32), sig[order], label)], ["sets", "sizes", "counts", "sigs", "labels"])
    bounds, first = key[40:41], dict(zip(zip(sig >> np.uint64(1), of, strict=True), index, strict=True))
    found = near._crossed(0.5, bounds)(bucket)
    pieces = found.filter(pa.array([k is None for k in found["block"].to_pylist()])).select(["names", "sizes", "codes", "m"]).rename_columns(["a", "b", "n", "m"])
    blocks = found.filter(pa.array([k is not None for k in found["block"].to_pylist()]))
    got = {(a, b) for names, _, i, j in near._unpacked(blocks) for a, b in zip(names[i].tolist(), names[j].tolist(), strict=True)}
    for b in near._expanded(0.5)(iter(pieces.add_column(0, "kind", pa.array(np.ones(len(pieces), np.int32))).to_batches())):
        got |= set(zip(b["a"].to_pylist(), b["b"].to_pylist(), strict=True))
    want = set()
    for k, sets in lists.items():
        for x, y in combinations(sets, 2):
            (_, _, x), (_, _, y) = sorted((size[z], key[z], z) for z in (x, y))
            if label[x] != label[y] and first[k, x] and size[y] * 0.5 <= size[x]:
                want.add(tuple(sorted((int(key[x]), int(key[y])))))
    assert (len(pieces) > 0) == (long_list == 6)
    assert want and (got >= want if len(pieces) else got == want)


def test_near_survey_sees_what_is_rare_in_each_slice(monkeypatch):
    """An n-gram once in each slice, never frequent in one, is still told from the sample."""
    monkeypatch.setattr(near, "_TASK_GRAMS", 50)
    rows = pa.RecordBatch.from_arrays([pa.array(range(2000)), pa.array([f"common words here x{k} y{k} " + " ".join(f"z{k}.{j}" for j in range(60)) for k in range(2000)])], ["doc_id", "text"])
    got = Counter()
    for k in range(0, 2000, 2):
        for batch in near._survey(3, 0.5)(iter([rows.slice(k, 2)])):
            got.update(a for kind, a in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if kind == 3)
    assert 8 <= max(got.values()) <= 80


def test_near_duplicates_go(spark, docs_of):
    rng = random.Random(2)
    a, c = words(rng, 60), words(rng, 60)
    b = ["x", *a[1:]]
    rows = [(5, " ".join(a)), (2, " ".join(b)), (9, " ".join(a)), (9, " ".join(a)), (4, " ".join(c)), (7, None), (None, "a"), (None, "a"), (8, ""), (6, "")]
    docs = docs_of(rows)
    for name in ("__gone", "id", "class_id", "a.b"):
        docs = docs.withColumn(name, F.lit(1))
    out = near.deduplicated(docs)
    assert out.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in out.collect()) == ["2", "4", "6", "7", "8", "None", "None"]
    assert near.deduplicated(docs_of([(1, "a")]).limit(0)).count() == 0


def intervals(rows, width):
    """Maximal runs of repeated windows of each document, those that come first and others."""
    windows = {}
    for i, text in sorted({(i, t) for i, t in rows if i is not None and t is not None}):
        w = text.split()
        for p in range(len(w) - width + 1):
            windows.setdefault(tuple(w[p : p + width]), set()).add((i, p))
    marks = {}
    for places in windows.values():
        if len(places) > 1:
            for k, (i, p) in enumerate(sorted(places)):
                marks.setdefault((i, k == 0), set()).add(p)
    out = set()
    for (i, first), places in marks.items():
        start = last = None
        for p in sorted(places):
            if start is None or p - last > width:
                if start is not None:
                    out.add((i, first, start, last + width))
                start = p
            last = p
        out.add((i, first, start, last + width))
    return out


def test_repeats_are_exact(docs_of):
    rng = random.Random(4)
    shared = [words(rng, 30) for _ in range(4)]
    rows = list(enumerate(HARD)) + [(None, "a b c d e f g h")]
    for k in range(40):
        parts = [words(rng, rng.randint(0, 40), 5000)]
        for _ in range(rng.randint(0, 2)):
            parts += [rng.choice(shared)[rng.randint(0, 9) :], words(rng, rng.randint(0, 20), 5000)]
        rows.append((100 + k, " ".join(" ".join(p) for p in parts)))
    rows += [rows[-1], (200, rows[-1][1])]
    got = [(r["doc_id"], r["first"], r["start"], r["stop"]) for r in repeats.repeated_intervals(docs_of(rows), 8).collect()]
    assert len(got) == len(set(got)) and set(got) == intervals(rows, 8)
    assert repeats.repeated_intervals(docs_of(rows).limit(0), 8).count() == 0


@pytest.mark.parametrize("few", [1_000_000, 0])
def test_repeats_removed(docs_of, monkeypatch, few):
    monkeypatch.setattr(repeats, "BROADCAST_ROWS", few)
    rng = random.Random(6)
    a, b, c = (" ".join(words(rng, 12, 9999)) for _ in range(3))
    rows = [(1, f"{a}\n{b}"), (2, f"{c} {b} tail"), (3, a), (4, None), (None, b), (5, "short")]
    docs = docs_of(rows)
    for name in ("__cuts", "cut_id", "cuts", "a.b"):
        docs = docs.withColumn(name, F.lit("own"))
    made = repeats.removed(docs, 8)
    assert made.columns == docs.columns
    out = {r["doc_id"]: r for r in made.collect()}
    assert all(r["cuts"] == r["a.b"] == "own" for r in out.values())
    assert out[1]["text"] == rows[0][1] and out[2]["text"].split() == f"{c} tail".split() and out[2]["n_chars"] == len(out[2]["text"])
    assert 3 not in out and out[4]["text"] is None and out[None]["text"] == b and out[5]["text"] == "short" and out[2]["key"] == "y"
