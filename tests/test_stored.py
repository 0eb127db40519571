"""Versioned tables and compile runs that die anywhere, vectors of texts and their index."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.operators import compiling, retrieval, vectors
from lodestar.sources.versions import Conflict, Versioned


class Killed(BaseException):
    """Ends a run as a lost process does: nothing catches it."""


def killer(at):
    """Ends a run at its nth step."""
    seen = []

    def step(name):
        seen.append(name)
        if len(seen) == at:
            raise Killed(name)

    step.seen = seen
    return step


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_a_version_is_old_or_new_wherever_a_write_dies(spark, tmp_path):
    whole = killer(0)
    Versioned(spark, f"{tmp_path}/all", step=whole).replace(spark.range(1))
    assert whole.seen == ["begin", "written", "pointed", "swapped", "cleaned"]
    for n in range(1, len(whole.seen) + 1):
        at = f"{tmp_path}/t{n}"
        Versioned(spark, at).replace(spark.range(3), batch=1)
        with pytest.raises(Killed):
            Versioned(spark, at, step=killer(n)).replace(spark.range(5), batch=2)
        table = Versioned(spark, at)
        new = n >= 4  # from the rename on
        assert ids(table.read()) == list(range(5 if new else 3))
        # the batch again, and then once more: nothing but the rows of batch 2, and nothing changes
        version = table.replace(spark.range(5), batch=2)
        assert ids(table.read()) == list(range(5)) and table.replace(spark.range(9), batch=2) == version and ids(table.read()) == list(range(5))
        assert table.replace(spark.range(7), batch=3) == version + 1 and ids(table.read()) == list(range(7))
        table.clean()
        assert len(table._listed("snapshots")) <= 3 and len(table._numbers()) == 2 and not [x for x in table._listed("versions") if x.startswith("_") and n != 3]


def test_versions(spark, tmp_path):
    t = Versioned(spark, f"file://{tmp_path}/t")
    assert t.read() is None and t.head() is None and t.read(1) is None
    assert [t.replace(spark.range(n), note=str(n)) for n in (1, 2, 3)] == [1, 2, 3]
    assert t.read(1) is None and ids(t.read(2)) == [0, 1] and t.head()["note"] == "3"
    with pytest.raises(Conflict):
        t.replace(spark.range(4), after=2)
    t.replace(spark.createDataFrame([], "id long, x string"), after=3)
    assert t.read().columns == ["id", "x"] and t.read().count() == 0
    # another writer was faster
    slow = Versioned(spark, f"{tmp_path}/t", step=lambda n: n == "written" and Versioned(spark, f"{tmp_path}/t").replace(spark.range(6)))
    with pytest.raises(Conflict):
        slow.replace(spark.range(7))
    assert ids(t.read()) == list(range(6))
    t.drop()
    assert t.read() is None


SOURCES = "ref string, kind string, hash string, text string"


def take_in(todo):
    page = F.struct(F.concat(F.lit("summaries/"), "ref").alias("id"), F.lit("summary").alias("type"), F.col("kind").alias("title"), F.col("text").alias("content"))
    shared = F.struct(F.lit("concepts/shared").alias("id"), F.lit("concept").alias("type"), F.lit("Shared").alias("title"), F.col("text").alias("content"))
    ok = F.col("text") != "bad"
    return todo.where("text <> 'lost'").select("ref", ok.alias("ok"), F.lit(None).cast("string").alias("error"), F.array(page, shared).alias("pages"))


def state(run):
    return {r["key"]: r["value"] for r in run.manifest().collect()}, {r["id"]: (r["content"], tuple(r["sources"])) for r in run.pages().collect()}


def test_compile(spark, tmp_path):
    run = compiling.Compiler(spark, f"{tmp_path}/wiki")
    first = spark.createDataFrame([("a", "article", "h1", "A"), ("b", "paper", "h2", "B"), ("c", "paper", "h3", "bad"), ("d", "paper", "h4", "lost"), ("e", "paper", "h2", "B")], SOURCES)
    t1 = spark.createDataFrame([("paper", "t1"), ("article", "t1")], "kind string, hash string")
    r = run.compile(first, take_in, templates=t1, now="2024-03-05 10:00:00")
    assert (r.mode, r.processed, r.created, r.updated, r.duplicates, r.errors, r.stale, r.pruned) == ("incremental", 5, 3, 0, 1, 2, 0, 0)
    known, pages = state(run)
    assert known == {"a": "h1", "b": "h2", "c": "failed:h3", "d": "failed:h4", "e": "h2", "_template/paper": "t1", "_template/article": "t1"}
    assert pages == {"summaries/a": ("A", ("a",)), "summaries/b": ("B", ("b",)), "concepts/shared": ("A", ("a", "b"))}
    # nothing new but what failed; then one change, and a template that changed
    assert run.compile(first, take_in, templates=t1).processed == 2
    second = spark.createDataFrame([("a", "article", "h1", "A"), ("b", "paper", "h9", "B2"), ("f", "article", "h6", "F")], SOURCES)
    r = run.compile(second, take_in, templates=t1)
    assert (r.processed, r.created, r.updated, r.pruned) == (2, 1, 2, 0)
    t2 = spark.createDataFrame([("paper", "t1"), ("article", "t2")], "kind string, hash string")
    assert run.compile(second, take_in, templates=t2).processed == 2 and run.compile(second, take_in, templates=t2).processed == 0
    # sources that are gone are pruned in a full run, but for those that were begun
    run.manifest_table.replace(run.manifest().union(spark.createDataFrame([("gone", "in_progress:h")], "key string, value string")))
    r = run.compile(second, take_in, full=True, templates=t2)
    assert (r.mode, r.processed, r.stale, r.pruned) == ("full", 3, 1, 3)
    assert set(state(run)[0]) == {"a", "b", "f", "gone", "_template/paper", "_template/article"}
    assert [x["value"] for x in spark.read.text(f"{tmp_path}/wiki/log").collect()] == ["- 2024-03-05 | compile | incremental compile: 5 sources, 3 pages created, 0 pages updated, 1 duplicate(s), 2 errors"]


def test_a_compile_that_dies_is_made_good(spark, tmp_path):
    old = spark.createDataFrame([("a", "article", "h1", "A"), ("x", "article", "h0", "X")], SOURCES)
    new = spark.createDataFrame([("a", "article", "h2", "A2"), ("b", "paper", "h3", "bad"), ("c", "paper", "h4", "C"), ("x", "article", "h0", "X")], SOURCES)

    def begin(name, step=lambda n: None):
        run = compiling.Compiler(spark, f"{tmp_path}/{name}", step)
        compiling.Compiler(spark, f"{tmp_path}/{name}").compile(old, take_in, batch=1)
        return run

    whole = killer(0)
    run = begin("whole", whole)
    run.compile(new, take_in, batch=2)
    before, after = state(begin("old")), state(run)
    assert after[0] == {"a": "h2", "b": "failed:h3", "c": "h4", "x": "h0"} and len(whole.seen) == 18
    for n in (4, 7, 11, 14, 17):  # in the first swap, between the steps, and in the other two swaps
        with pytest.raises(Killed):
            begin(f"t{n}", killer(n)).compile(new, take_in, batch=2)
        run = compiling.Compiler(spark, f"{tmp_path}/t{n}")
        known, pages = state(run)
        assert pages in (before[1], after[1])
        assert all(known.get(k) in (before[0].get(k), f"in_progress:{after[0][k].split(':')[-1]}", after[0][k]) for k in after[0])
        open_ = {k for k, v in known.items() if v.startswith("in_progress:")}
        r = run.compile(new, take_in, batch=2)
        assert state(run) == after and (r.stale == len(open_))
        version = run.manifest_table.head()["version"]
        run.compile(new, take_in, batch=2)
        assert run.manifest_table.head()["version"] == version


def test_rebuild(spark, tmp_path):
    run = compiling.Compiler(spark, f"{tmp_path}/wiki")
    run.compile(spark.createDataFrame([("a", "article", "h1", "alpha beta"), ("b", "article", "h2", "gamma delta")], SOURCES), take_in)
    assert run.rebuild("2024-03-05 10:00:00") == {"manifest": "cleared", "search": "cleared", "vectors": "cleared"}
    assert run.manifest().count() == 0 and run.pages().count() == 3
    assert {r["id"] for r in retrieval.ask_index(spark, f"{tmp_path}/wiki/search", "gamma").collect()} == {"summaries/b"}
    index = vectors.VectorIndex(spark, f"{tmp_path}/wiki/vectors")
    near = retrieval.asked_index(index, "gamma delta", 3)
    assert near.orderBy(F.desc("similarity")).first()["id"] == "summaries/b"
    assert "rebuild-indexes | manifest=cleared search=cleared vectors=cleared caches_cleared=1" in spark.read.text(f"{tmp_path}/wiki/log").first()["value"]


def test_vectors_of_texts(spark):
    rows = [(1, "Cats chase mice"), (2, "mice chase cats cats"), (3, None), (4, ""), (5, "the and of"), (6, "Cats chase mice"), (7, "cats " * 70_000)]
    df = spark.createDataFrame(rows, "id long, content string")
    for dim in (1, 64, 200):
        got = {r["id"]: np.array(r["embedding"]) for r in vectors.embedded(df, dim).collect()}
        assert all(len(v) == dim for v in got.values())
        assert not got["3"].any() and not got["4"].any() and not got["5"].any()
        assert (got["1"] == got["6"]).all() and abs(np.linalg.norm(got["7"]) - 1) < 1e-12
    assert got["1"] @ got["2"] > 0.9 > abs(got["1"] @ got["7"])
    with pytest.raises(ValueError):
        vectors.embedded(df, 0)


def test_vectors_of_a_table_of_terms(spark):
    df = spark.createDataFrame([(1, "cats chase mice"), (2, "cats cats dogs"), (3, None), (4, "unknown words")], "id long, content string")
    terms = spark.createDataFrame([("cats", [1.0, 0.0]), ("mice", [0.0, 1.0]), ("dogs", [0.0, -2.0]), ("dogs", [9.0, 9.0])], "term string, embedding array<double>")
    got = {r["id"]: r["embedding"] for r in vectors.embedded_by(df, terms).collect()}
    assert got["3"] is None and got["4"] is None
    assert np.allclose(got["1"], [0.5**0.5, 0.5**0.5]) and np.allclose(got["2"], [0.5**0.5, -(0.5**0.5)])


@pytest.mark.parametrize("kind", ["groups", "scattered"])
def test_the_index_finds_what_a_scan_finds(spark, tmp_path, kind):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 32))
    if kind == "groups":
        x = rng.normal(size=(40, 32))[rng.integers(40, size=3000)] * 4 + 0.3 * x
    rows = [(f"v{i:04d}", v.tolist()) for i, v in enumerate(x)]
    odd = [("n", None), ("short", [1.0, 2.0]), ("nan", [float("nan")] * 32), ("inf", [float("inf")] + [0.0] * 31), ("hole", [None] + [0.0] * 31)]
    df = spark.createDataFrame([*rows, *odd], "id string, embedding array<double>")
    index = vectors.VectorIndex(spark, f"{tmp_path}/v")
    assert index.ask([0.0] * 32).collect() == []
    index.build(df)
    names, found, read = [r[0] for r in rows], [], []
    own = index._of
    index._of = lambda part, cell: read.append(len(cell)) or own(part, cell)
    for q in [*x[:6], *rng.normal(size=(4, 32))]:
        d = np.sqrt(((x - q) ** 2).sum(1))
        want = [names[i] for i in np.lexsort((names, d))[:10]]
        found.append(len(set(want) & {r["id"] for r in index.ask(q.tolist(), 10).collect()}) / 10)
        assert [r["id"] for r in index.ask(q.tolist(), 10, exact=True).collect()] == want
    assert np.mean(found) >= 0.95
    if kind == "groups":
        assert np.median(read) <= 16  # of 55 cells
    asked = spark.createDataFrame([(str(i), x[i].tolist()) for i in range(6)] + [("other", [1.0])], "question string, embedding array<double>")
    got = index.ask_all(asked, 5).collect()
    assert len(got) == 30
    for r in got:
        d = np.sqrt(((x - x[int(r["question"])]) ** 2).sum(1))
        assert names[np.lexsort((names, d))[r["rank"] - 1]] == r["id"]
    assert index.ask([0.0] * 31).collect() == [] and index.ask([float("nan")] * 32).collect() == [] and index.ask([0.0] * 32, 0).collect() == []


def test_an_index_is_swapped_whole(spark, tmp_path):
    one = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "id string, embedding array<double>")
    two = spark.createDataFrame([("c", [1.0, 0.0, 0.0])], "id string, embedding array<double>")
    for n in range(1, 6):
        index = vectors.VectorIndex(spark, f"{tmp_path}/i{n}")
        index.build(one)
        with pytest.raises(Killed):
            vectors.VectorIndex(spark, f"{tmp_path}/i{n}", step=killer(n)).build(two)
        old = [r["id"] for r in index.ask([1.0, 0.0], 5).collect()]
        new = [r["id"] for r in index.ask([1.0, 0.0, 0.0], 5).collect()]
        assert (old, new) == ((["a", "b"], []) if n < 4 else ([], ["c"]))
    index.build(spark.createDataFrame([], "id string, embedding array<double>"))
    assert index.ask([1.0, 0.0]).collect() == [] and index.ask_all(one.withColumnRenamed("id", "question")).collect() == []
    with pytest.raises(ValueError):
        index.build(spark.createDataFrame([("a", [])], "id string, embedding array<double>"))


def test_the_facade_asks_the_index(spark, tmp_path):
    from lodestar.api import Wiki

    rows = [("c/a", "concept", "Alpha", "alpha beta gamma"), ("c/b", "concept", "Delta", "delta epsilon"), ("c/c", "concept", "Zeta", "zeta alpha")]
    pages = spark.createDataFrame(rows, "id string, type string, title string, content string").withColumns({"status": F.lit("seed"), "authored_by": F.lit("llm"), "source": F.lit("raw/x.md"), "updated": F.lit("2024-01-01")})
    wiki = Wiki(pages, spark.createDataFrame([], "src string, pos int, target string"), "2025-01-15")
    wiki.index_vectors(f"{tmp_path}/v")
    assert wiki.hybrid(f"{tmp_path}/v", "delta epsilon", 1).first()["id"] == "c/b"
    assert wiki.hybrid(f"{tmp_path}/v", "the", 3).collect() == []
    linked = wiki.link_titles(spark.createDataFrame([(0, "Alpha", "c/a")], "nth int, title string, target string")).collect()
    assert [(r["id"], r["content"]) for r in linked] == [("c/c", "zeta [[c/a|Alpha]]")]
