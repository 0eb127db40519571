"""Findings of round 3, each on the smallest input that shows it."""

import pytest
from compare import both

from lodestar import catalog
from lodestar.functions import text
from lodestar.operators import edit, graph, linking


def documents(spark, tmp_path, texts):
    """A folder with a documents table of some texts."""
    rows = [(i, t, "en", "web", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def same_as_sql(spark, name, sf):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet/*.parquet'")
    mine, other = both(spark, catalog.queries()[name], catalog.oracle_sql()[name], sf, con)
    assert mine == other
    return mine[1]


def test_betweenness_takes_one_table_a_layer_each_way(spark, monkeypatch):
    monkeypatch.setattr(graph, "SUMMED", 2)
    made = []
    monkeypatch.setattr(graph, "saved", lambda df, what="table", own=graph.saved: made.append(what) or own(df, what))
    n, chain = 7, [(f"n{i}", f"n{i + 1}") for i in range(6)]
    got = graph.betweenness(spark.createDataFrame([(f"n{i}",) for i in range(n)], "id string"), spark.createDataFrame(chain, "src string, dst string"), batch=7)
    assert {r["id"]: round(r["score"] * 30) for r in got.collect()} == {f"n{i}": i * (6 - i) for i in range(n)}
    assert len(made) <= 3 + 2 * n + n // 2 + 1  # three a layer before, and two more


def test_volatile_topic_in_a_title(spark, tmp_path):
    sf = documents(spark, tmp_path, ["x", "an agent of mcp", "réact dockeré claude"])
    same_as_sql(spark, "d2_volatility", sf)


@pytest.mark.parametrize("first", ["ßx", "ẞx", "ŉx", "ᾀx", "İİ", "ǆx", "ΣΣ", "ﬁx"])
def test_first_letter_stays_one(spark, tmp_path, first):
    same_as_sql(spark, "f5_fallbacks", documents(spark, tmp_path, [first, first + " AΣ b"]))


def test_capitals_are_one_letter(spark):
    rows = spark.createDataFrame([(c,) for c in text._WIDE], "c string").select("c", text.capital("c").alias("u"))
    assert {len(r["u"]) for r in rows.collect()} == {1}


def test_titles_meet_pages_by_runs_of_words(spark):
    """Titles that share their longest word do not all meet every page that has it."""
    say = lambda i: f"conglomerates like {chr(97 + i)} grow"
    pages = spark.createDataFrame([(f"p/{i}", f"On {say(i)}.") for i in range(20)], "id string, content string")
    titles = spark.createDataFrame([(i, say(i), f"t/{i}") for i in range(20)], "nth int, title string, target string")
    assert linking.met(pages, titles).count() == 20
    assert {(r["id"], *r["targets"]) for r in linking.injected(pages, titles).collect()} == {(f"p/{i}", f"t/{i}") for i in range(20)}


def test_mentions_fold_a_text_once(spark):
    pages = spark.createDataFrame([("p", "Aa bb-cc dd aa"), ("q", "xbb ccx")], "id string, content string")
    titles = spark.createDataFrame([("bb-cc", "t/1"), ("aa", "t/2"), ("cc dd aa bb", "t/3")], "title string, target string")
    assert [tuple(r) for r in edit.mentions(pages, titles).collect()] == [("p", "t/1")]
    plan = edit.mentions(pages, titles)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array(lower(content") == 1  # the text was folded for each title, in a filter and again in the answer


def test_digests_are_read_in_place():
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from lodestar.operators import vectors

    raw = np.random.default_rng(0).integers(0, 256, (200_000, 16), np.uint8)
    batch = pa.RecordBatch.from_arrays([pa.array([str(i) for i in range(100)]), pa.array([[r.tobytes() for r in raw[i : i + 2000]] for i in range(0, 200_000, 2000)], pa.list_(pa.binary()))], names=["id", "digests"])
    tracemalloc.start()
    (out,) = vectors._summed(64)([batch.slice(7)])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    bits = np.unpackbits(raw, axis=1)[:, :64].reshape(100, 2000, 64).astype(int)
    assert out.column(1).to_pylist() == (2 * bits - 1).sum(1)[7:].tolist()
    assert peak < 4 << 20  # 13 MB where every digest became an object


def test_cycles_of_two_links_take_no_components(spark, monkeypatch):
    e = spark.createDataFrame([("b", "a"), ("a", "b"), ("b", "c"), ("c", "d"), ("d", "b"), ("d", "c"), ("x", "x"), ("a", "x"), ("a", "b")], "src string, dst string")
    monkeypatch.setattr(graph, "strong_components", None)
    assert [tuple(r) for r in graph.cycles(e, 2).collect()] == [(2, "a > b"), (2, "c > d")]
    assert [tuple(r) for r in graph.cycles(e, 2, most=1).collect()] == [(2, "a > b"), (0, "__truncated__")]


def test_rounds_of_components_broadcast_nothing(spark, monkeypatch):
    """Small tables of many rounds would all go through the driver."""
    plans = []
    monkeypatch.setattr(graph, "saved", lambda df, what="table", own=graph.saved: plans.append(df._jdf.queryExecution().executedPlan().toString()) or own(df, what))
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "d")], "src string, dst string")
    assert {tuple(r) for r in graph.strong_components(e).collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("d", "d"), ("e", "d")}
    assert plans and not [p for p in plans if "Broadcast" in p]


def test_an_index_makes_its_vectors_once(spark, tmp_path):
    from lodestar.operators import vectors

    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    rows = spark.createDataFrame([(str(i), [float(i), 1.0] if i % 5 else [1.0]) for i in range(40)], "id string, embedding array<double>")
    index = vectors.VectorIndex(spark, str(tmp_path / "index"))
    index.build(rows.mapInArrow(counted, rows.schema))
    assert made.value == 40
    assert [r["id"] for r in index.ask([7.0, 1.0], 3, exact=True).orderBy("distance", "id").collect()] == ["7", "6", "8"]


def test_a_batch_digests_a_term_once(monkeypatch):
    import hashlib

    import numpy as np
    import pyarrow as pa

    from lodestar.operators import vectors

    asked = []
    monkeypatch.setattr(vectors, "_digest", lambda t, dim, own=vectors._digest: asked.append(t) or own(t, dim))
    lists = [["a", "é", "a"], [], ["b"] * 3 + ["a"]] * 50
    batch = pa.RecordBatch.from_arrays([pa.array([str(i) for i in range(150)]), pa.array(lists, pa.list_(pa.string()))], names=["id", "terms"]).slice(1)
    out = pa.Table.from_batches(list(vectors._vectors(200)([batch])))
    bits = lambda t: np.unpackbits(np.frombuffer(b"".join(hashlib.md5(f"{k}:{t}".encode()).digest() for k in range(2)), np.uint8))[:200].astype(float)
    want = [sum((2 * bits(t) - 1 for t in ts), np.zeros(200)) for ts in lists[1:]]
    assert out.column("embedding").to_pylist() == [(w / max(np.sqrt((w**2).sum()), 1e-300)).tolist() for w in want]
    assert out.column("id").to_pylist() == [str(i) for i in range(1, 150)] and len(asked) == 3


def test_slugs_are_shuffled_as_numbers(spark, monkeypatch):
    """Every string of a slug took the slug, its id and the string through two shuffles, and every candidate pair both slugs."""
    import random

    from lodestar.operators import lint

    rng = random.Random(3)
    ids = {"".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 40))) for _ in range(60)}
    ids |= {x[:-2] + "zz" for x in ids} | {x.upper() for x in list(ids)[:9]} | {"a_b", "a-b", "a-c"}
    plans = []
    monkeypatch.setattr(lint, "saved", lambda df, what="table", own=lint.saved: plans.append((what, df._jdf.queryExecution().executedPlan().toString())) or own(df, what))
    got = lint.alike_slugs(spark.createDataFrame([(x,) for x in ids], "id string")).collect()

    def far(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    fold = {x: x.lower().replace("_", "-") for x in ids}
    want = {(a, b, d) for a in ids for b in ids if a < b and abs(len(a) - len(b)) <= 3 and 1 <= (d := far(fold[a], fold[b])) <= 3}
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert [what for what, _ in plans] == ["ids", "slugs", "keys"]  # the strings themselves were a table too


def test_no_task_goes_through_all_calls(spark, monkeypatch):
    """All calls were one segment, which one task sorted; order, window and what runs have had must hold from piece to piece, also inside one second."""
    import random
    from collections import defaultdict, deque

    from pyspark.sql import functions as F

    from lodestar.operators import augment

    monkeypatch.setattr(augment, "PIECE", 120, raising=False)
    rng, calls, at = random.Random(11), [], 10_000
    for i in range(900):
        at += 0 if 300 < i < 420 else rng.choice([0, 0, 1, 20, 70]) if i != 600 else 500
        calls.append((rng.choice([None, *range(25)]), rng.choice([None, "a", "b", "c"]), i, at))
    frame = lambda rows: spark.createDataFrame(rows, "run int, host string, entry long, at long")
    got = augment.fetch_limited(frame(rng.sample(calls, len(calls)) + [(1, "a", 900, None)]), 5, 2, 6, 100)
    every, hosts, runs, want = deque(), defaultdict(deque), defaultdict(int), {}
    for run, host, i, at in calls:
        for q in (every, hosts[host]):
            while q and q[0] < at - 100:
                q.popleft()
        full = every if len(every) >= 5 else hosts[host] if len(hosts[host]) >= 2 else None
        ok = runs[run] < 6 and full is None
        want[i] = (ok, 0 if runs[run] >= 6 or full is None else max(1, full[0] + 100 - at + 1))
        if ok:
            every.append(at)
            hosts[host].append(at)
            runs[run] += 1
    assert {r["entry"]: (r["accepted"], r["retry"]) for r in got.collect()} == want
    assert sum(n >= 6 for n in runs.values()) > 5 and sum(w > 0 for _, w in want.values()) > 100
    held = [r["n"] for r in got.groupBy(F.input_file_name()).agg(F.count("*").alias("n")).collect()]
    assert sum(held) == 900 and max(held) <= 200
    assert augment.fetch_limited(frame([])).count() == 0
