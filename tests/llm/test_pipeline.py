"""Every stage of the pipeline against brute force on its own input, and the whole."""

import re

import pytest
from test_dedup import LOW, near_brute

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    """Input and output of each stage."""
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stages") / str(i))
        stage(spark, docs, sf).write.parquet(path)
        out[name] = (docs, spark.read.parquet(path))
        docs = out[name][1]
    return out


def test_columns(stages):
    for name, (before, after) in list(stages.items())[:-1]:
        assert after.columns == before.columns and dict(after.dtypes) == dict(before.dtypes)


def test_language_keeps_clean_documents(stages):
    before, after = stages["language ID"]
    letters = before.where("text rlike '\\\\p{L}'")
    assert after.count() >= 0.99 * letters.count() and after.join(letters, "doc_id", "left_anti").count() == 0


def test_exact(stages):
    before, after = stages["exact dedup"]
    keep = {}
    for r in before.collect():
        k = (r["text"] or "").translate(LOW)
        keep[k] = max(keep.get(k, -1), r["doc_id"])
    assert {r["doc_id"] for r in after.collect()} == set(keep.values())


def test_near(stages):
    before, after = stages["MinHash near-dedup"]
    brute = near_brute([(r["doc_id"], r["text"]) for r in before.collect()], 5)
    assert {r["doc_id"] for r in after.collect()} == {d for d, (_, _, kept) in brute.items() if kept}


def test_passages(stages):
    before, after = stages["suffix-array dedup"]
    rows, first = sorted((r["doc_id"], r["text"]) for r in before.collect()), {}
    for d, t in rows:
        b = t.encode()
        for i in range(len(b) - 49):
            first.setdefault(b[i : i + 50], d)
    want = {}
    for d, t in rows:
        b, gone = t.encode(), set()
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < d:
                gone.update(range(i, i + 50))
        want[d] = bytes(x for i, x in enumerate(b) if i not in gone).decode("utf-8", "ignore")
    got = {r["doc_id"]: r for r in after.collect()}
    assert {d: r["text"] for d, r in got.items()} == want
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())


def test_packed_whole(stages):
    before, after = stages["best-fit packing"]
    assert {r["doc_id"] for r in after.collect()} == {r["doc_id"] for r in before.collect()}
    assert re.fullmatch(r"doc_id,piece,start,length,ids_crc32,sequence_id,offset", ",".join(after.columns))


ODD = "doc_id long, text string, lang string, source string, n_chars long, KEPT string, __row int, score double"


def odd(spark):
    words = " ".join(f"w{i}" for i in range(40))
    passage = "a passage that stands in two documents and is longer than fifty bytes, as can be seen"
    rows = [
        (1, None, None, None, None, "a", 1, 0.5), (2, "", "en", "s", 0, "a", 1, None), (3, "?!", "en", "s", 2, None, 1, None), (4, words, "en", "s", 1, "b", 2, 1.0), (4, words, "en", "s", 1, "b", 2, 1.0),
        (5, words.upper(), "en", "s", 1, "c", 3, 1.0), (6, words + " more", "en", None, 1, "d", 4, 1.0), (None, words, "en", "s", 1, "e", 5, 1.0), (7, passage + " first.", "en", "s", 1, None, 6, 1.0), (8, "Then " + passage, "en", "s", 1, None, 7, 1.0),
        (9, "x" * 300_000, "en", "s", 1, None, 8, 1.0),
    ]
    return spark.createDataFrame(rows, ODD)


@pytest.mark.parametrize("stage", [0, 1, 2, 3])
def test_stages_keep_odd_rows_and_columns(spark, sf, stage):
    name, fn = corpus_pipeline.STAGES[stage]
    docs = odd(spark)
    out = fn(spark, docs, sf)
    rows = out.collect()
    assert out.columns == docs.columns
    ids = sorted(r["doc_id"] or 0 for r in rows)
    assert ids == {0: [0, 4, 4, 5, 6, 7, 8, 9], 1: [2, 3, 5, 6, 7, 8, 9], 2: [0, 1, 2, 3, 4, 4, 7, 9], 3: [0, 1, 2, 3, 4, 4, 5, 6, 7, 8, 9]}[stage]
    by = {r["doc_id"]: r for r in rows}
    if stage == 3:
        assert by[8]["text"] == "Then " and by[6]["text"] == "" or by[6]["text"].endswith("more")
        assert by[7]["text"].endswith("first.") and by[1]["text"] is None and by[None]["text"].startswith("w0") and by[9]["n_chars"] == 300_000
    assert fn(spark, docs.where("false"), sf).count() == 0


def test_packing_of_odd_rows(spark, sf):
    _, fn = corpus_pipeline.STAGES[4]
    rows = fn(spark, odd(spark), sf).collect()
    assert sorted({r["doc_id"] or 0 for r in rows}) == [0, 1, 2, 3, 4, 5, 6, 7, 8, 9] and sum(r["doc_id"] == 4 for r in rows) == 2
    assert fn(spark, odd(spark).where("false"), sf).count() == 0
