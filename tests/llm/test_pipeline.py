"""The pipeline, stage by stage and as a whole, on a small corpus with planted cases."""

import random
from collections import Counter

import corpus_pipeline
from silvestra.llm import near, queries


def corpus(spark, folder):
    rng = random.Random(11)
    text = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    plain = [text(rng.randint(60, 120)) for _ in range(60)]
    near = plain[0].split()
    near[7] = "changed"
    passage = text(70)
    texts = [*plain, plain[0], " ".join(near), f"{text(30)} {passage} {text(30)}", f"{text(25)} {passage} {text(25)}", f"you idiot scum {text(20)} worthless moron", None, "", "one"]
    rows = [(k, t, "en", f"s{k % 2}" if t else None, len(t) if t else 0) for k, t in enumerate(texts)] + [(None, "no id here", None, "s0", 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, 1, int(k == 64)) for k in range(70)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return rows, passage


def test_stages(spark, tmp_path):
    rows, passage = corpus(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, kept = docs.columns, {r[0] for r in rows}
    expected = [kept - {64}, kept - {64, 60, 61}, kept - {64, 60, 61}]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert out.columns == columns
            out.write.parquet(f"{tmp_path}/stage{k}")
            docs = spark.read.parquet(f"{tmp_path}/stage{k}")
        if k < 3:
            assert {r["doc_id"] for r in docs.collect()} == expected[k]
        if k == 2:
            texts = {r["doc_id"]: r["text"] for r in docs.collect()}
            assert passage in texts[62] and passage not in texts[63] and texts[5] == rows[5][1]
        if k == 3:
            tokens = sum(len((r["text"] or "").split()) for r in docs.collect())
            assert 0.9 * sum(len((t or "").split()) for t in texts.values()) <= tokens <= sum(len((t or "").split()) for t in texts.values())
        if k == 4:
            assert sum(r["n_tokens"] for r in out.collect()) == tokens
    assert sum(r["n_tokens"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == tokens


def test_stages_of_hard_rows(spark, tmp_path):
    """Nulls in all columns, very long and repeated rows, columns of names that stages use themselves."""
    rng = random.Random(12)
    long = " ".join(f"v{rng.randrange(50_000)}" for _ in range(60_000))
    rows = [(1, long, "en", "a", 9), (2, long, "de", "b", 9), (1, long, "en", "a", 9), (3, None, None, None, None), (None, "some words here", "en", None, 1), (4, "", "en", "a", 0), (5, "x " * 5000, "en", "a", 1), (5, "x " * 5000, "en", "a", 1), (6, "other text of its own", None, "c", 3)]
    docs = spark.createDataFrame([(*r, *["own"] * 8) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, id string, row string, cuts string, cut_id string, __gone string, class_id string, key string, h string")
    spark.createDataFrame([(1, 1, 0), (None, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert out.columns == docs.columns, name
            out.write.parquet(f"{tmp_path}/hard{k}")
            docs = spark.read.parquet(f"{tmp_path}/hard{k}")
            assert {r["cuts"] for r in docs.collect()} == {"own"}
        if k == 1:
            assert Counter(r["doc_id"] for r in docs.collect()) == Counter([1, 1, 3, None, 4, 5, 5, 6])
    assert sum(r["n_tokens"] for r in out.collect()) == sum(len((r["text"] or "").split()) for r in docs.collect()) > 0


def test_stages_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, str(tmp_path)).count() == 0


def test_names():
    assert len(corpus_pipeline.STAGES) == 5
    assert {n.split("_")[0] for n in queries.QUERIES} == {*(f"op{k}" for k in range(1, 11)), "pipeline"}
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)


def test_stage_of_near_copies_writes_no_row_a_pair(docs_of, spark, monkeypatch):
    """Of a cluster of different near copies one stays, and no table written has as many rows as they have pairs."""
    rng, written, kept = random.Random(13), [], near.kept
    text = [f"w{rng.randrange(3000)}" for _ in range(60)]
    docs = docs_of([(k, " ".join([*text, f"own{k}"])) for k in range(80)])
    monkeypatch.setattr(near, "kept", lambda df, *by, **k: (out := kept(df, *by, **k), written.append(out.count()))[0])
    assert [r["doc_id"] for r in corpus_pipeline.one_of_near_copies(spark, docs, "").collect()] == [0]
    assert written and max(written) < 80 * 79 / 4


def test_stage_of_near_copies_lists_few_pairs_of_a_cluster(docs_of, spark, monkeypatch):
    """Of a cluster of different near copies the pairs that are written, packed ones too, are far fewer than there are."""
    rng, pairs, stored = random.Random(14), [], near.stored
    text = [f"w{rng.randrange(3000)}" for _ in range(60)]
    docs = docs_of([(k, " ".join([*text, f"own{k}"])) for k in range(200)])

    def counted(df, *by, **k):
        path = stored(df, *by, **k)
        if "codes" in df.columns:
            rows = spark.read.parquet(path).where("block is not null").select("names", "sizes", "codes").toArrow()
            pairs.append(sum(len(i) for _, _, i, _ in near._unpacked(rows)))
        return path

    monkeypatch.setattr(near, "stored", counted)
    monkeypatch.setattr(near, "kept", lambda df, *by, **k: spark.read.schema(df.schema).parquet(counted(df, *by, **k)))
    assert [r["doc_id"] for r in corpus_pipeline.one_of_near_copies(spark, docs, "").collect()] == [0]
    assert pairs and max(pairs) < 200 * 199 / 8
