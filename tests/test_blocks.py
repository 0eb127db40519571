"""Vectors asked in blocks, and postings counted by page."""

import numpy as np

from lodestar.operators import vectors


def test_slices_and_blocks_give_the_nearest_of_all(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vectors, "MET", 256)  # slices of 32 vectors, blocks of 32 questions
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 8)).round(1)
    x[300:340] = x[0]  # copies: ties go by id
    names = [str(i) for i in range(400)]
    df = spark.createDataFrame([(names[i], x[i].tolist()) for i in range(400)], "id string, embedding array<double>")
    index = vectors.VectorIndex(spark, f"{tmp_path}/i")
    index.build(df)
    got = {}
    for r in index.ask_all(df.where("id % 4 = 0").withColumnRenamed("id", "question"), 7).collect():
        got[r["question"], r["rank"]] = r["id"], r["distance"]
    assert len(got) == 700
    for q in range(0, 400, 4):
        d = np.sqrt(np.add.accumulate((x - x[q]) ** 2, 1)[:, -1])
        want = sorted(zip(d.tolist(), names))[:7]
        assert [got[str(q), k + 1] for k in range(7)] == [(n, v) for v, n in want]


def test_postings_are_counted_without_a_shuffle_of_words(spark, tmp_path):
    from lodestar.operators import retrieval

    rows = [("a", "Heat", "heat heat nter café"), ("b", None, "heat x"), ("c", "t", None), ("d", "", ""), ("e", "ened ened", "the tionin heat")]
    pages = spark.createDataFrame(rows, "id string, title string, content string").fillna("")
    retrieval.write_index(pages, f"{tmp_path}/i")
    stored = spark.read.parquet(f"{tmp_path}/i/postings")
    assert sorted(r["id"] for r in stored.where("term IS NULL").collect()) == ["a", "b", "c", "d", "e"]  # a row a page; only empty pages had one
    assert {(r["term"], r["tf"]) for r in stored.where("id = 'a' AND term IS NOT NULL").collect()} == {("heat", 5), ("nter", 1), ("café", 1)}
    for q in ("heat", "ened heat café", "the", "none"):
        want = {r["id"]: round(r["score"], 9) for r in retrieval.bm25(pages, q).collect()}
        assert {r["id"]: round(r["score"], 9) for r in retrieval.ask_index(spark, f"{tmp_path}/i", q).collect()} == want
