"""Operators on small inputs with known answers."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestar.functions import dates, text
from lodestar.operators import edit, graph, lint, models, publish, records, retrieval
from lodestar.plans import scalars


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_tokens(spark):
    assert one(spark, text.tokens(F.lit("Hello World"))) == ["hello", "world"]
    assert "fine-tuning" in one(spark, text.tokens(F.lit("fine-tuning is great")))
    assert one(spark, text.tokens(F.lit("the is of a x"))) == []


@pytest.mark.parametrize(("given", "slug"), [("C++", "cpp"), ("C#", "csharp"), (".NET", "dotnet"), ("mylib++", "mylibplus"), ("GPT 3.5 Turbo", "gpt-3-5-turbo"), ("a_b  c", "a-b-c")])
def test_slugs(spark, given, slug):
    assert one(spark, text.slug(F.lit(given))) == slug


def test_slug_of_nothing(spark):
    assert one(spark, text.slug(F.lit("!!!"))).startswith("untitled-")


def test_wikilinks_leave_code_and_pictures(spark):
    assert one(spark, text.wikilinks(F.lit("[[A/B.md|x]] `[[c]]` ![[d]]\n```\n[[e]]\n```\n[[ f ]]"))) == ["a/b", "f"]


def test_secrets(spark):
    assert one(spark, text.secret_label(F.lit("x AKIA" + "A" * 16))) == "AWS access key"
    assert one(spark, text.secret_line(F.lit("a\nb\nAKIA" + "A" * 16))) == 3
    assert one(spark, text.secret_label(F.lit("bearer responsibility-for-all-of-us"))) is None


def test_callouts(spark):
    got = one(spark, text.callouts(F.lit("> [!GAP] x\nnot > [!stale]\n> [!key-insight] y")))
    assert [(r["line"], r["marker"]) for r in got] == [(1, "gap"), (3, "key-insight")]
    assert one(spark, text.callouts(F.lit("> [!gap]" + "x" * 1_048_576))) == []


def test_rewrites(spark):
    ask = lambda s: one(spark, text.should_rewrite(F.lit(s)))
    assert not ask("Who is Andrew Ng?") and ask("what about it") and ask("tell me more") and not ask("什么是RAG")


def test_trust():
    assert [round(dates_trust(*x), 4) for x in ((1, 0, 0), (0, 1, 0), (2, 1, 0))] == [0.6667, 0.25, 0.5]


def dates_trust(u, w, i):
    return (u + 1) / (u + 2 * w + i + 2)


def test_trust_of_frames(spark):
    f = spark.createDataFrame([("p", "useful", 1), ("q", "wrong", 1), ("r", "useful", 1), ("r", "useful", 2), ("r", "wrong", 3)], "page string, rating string, ts int")
    assert {r["page"]: r["trust"] for r in records.page_trust(f).collect()} == {"p": 0.6667, "q": 0.25, "r": 0.5}


def test_decay(spark):
    assert one(spark, dates.decay_days(F.lit("https://evilarxiv.org/"))) == 90
    assert one(spark, dates.decay_days(F.lit("https://export.arxiv.org/abs/1"), F.lit("an LLM"))) == 1204


def test_fusion(spark):
    lists = [spark.createDataFrame(x, "id string, rank int") for x in ([("a", 0), ("b", 1)], [("b", 0), ("c", 1)])]
    got = {r["id"]: r["score"] for r in retrieval.fused(lists).collect()}
    assert max(got, key=got.get) == "b" and got["a"] == 1 / 60


def test_bm25_ranks(spark):
    p = spark.createDataFrame([("d0", "", "retrieval augmented generation with retrieval"), ("d1", "", "nothing to see here")], "id string, title string, content string")
    assert [r["id"] for r in retrieval.bm25(p, "retrieval augmented generation").collect()] == ["d0"]
    assert retrieval.bm25(p, "the of").count() == 0


def dedup_fold(rows, jaccard=0.85, share=0.6):
    import math

    kept = []
    for s, i, t, w in sorted((-s, i, t, frozenset(w)) for i, t, w, s in rows):
        if not any(k[2] == t and len(k[3] & w) / len(k[3] | w) > jaccard for k in kept):
            kept.append((s, i, t, w))
    out = []
    for k in kept:
        if sum(o[2] == k[2] for o in out) < max(1, math.ceil((len(out) + 1) * share)):
            out.append(k)
    return [k[1] for k in out]


def test_dedup_is_the_fold(spark):
    import random

    rng = random.Random(4)
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta"]
    rows = [(f"p{i}", rng.choice(["concept", "entity", "summary"]), rng.sample(words, rng.randint(2, 5)), float(rng.randint(1, 9))) for i in range(30)]
    df = spark.createDataFrame([(i, t, " ".join(w), s) for i, t, w, s in rows], "id string, type string, content string, score double")
    assert [r["id"] for r in retrieval.deduped(df).orderBy("rank").collect()] == dedup_fold(rows)


def test_context_skips_what_does_not_fit(spark):
    df = spark.createDataFrame([(0, "a", "concept", "x" * 50), (1, "b", "summary", "x" * 30), (2, "c", "concept", "x" * 40), (3, "d", "concept", "x" * 15)], "rank int, id string, type string, content string")
    assert [(r["id"], r["taken"]) for r in retrieval.context(df, 100, 40).collect()] == [("b", 30), ("a", 50), ("d", 15)]


def test_rate_limit_forgets_rejected_calls(spark):
    calls = spark.createDataFrame([("k", 1, 0), ("k", 2, 10), ("k", 3, 20), ("k", 4, 3601), ("k", 5, 3602)], "key string, entry long, at long")
    got = {r["entry"]: r["accepted"] for r in records.limited(calls, 2).collect()}
    assert got == {1: True, 2: True, 3: False, 4: True, 5: False}


def test_contradiction(spark):
    claims = spark.createDataFrame([(1, "Network latency is never high in mobile networks.")], "claim int, text string")
    p = spark.createDataFrame([("a", "Intro. Mobile network latency is always high in networks."), ("b", "Unrelated words.")], "id string, content string")
    assert [r["id"] for r in records.contradictions(claims, p).collect()] == ["a"]


def test_alike_slugs(spark):
    ids = ["attention", "attnetion", "attention-mechanism", "foo", "foobar", "Foo"]
    got = {(r["id"], r["id2"]): r["distance"] for r in lint.alike_slugs(spark.createDataFrame([(i,) for i in ids], "id string")).collect()}
    assert got[("attention", "attnetion")] == 2 and ("attention", "attention-mechanism") not in got
    assert got[("foo", "foobar")] == 3 and ("Foo", "foo") not in got


def edges_of(spark, pairs):
    return spark.createDataFrame(pairs, "src string, dst string"), spark.createDataFrame(sorted({(x,) for p in pairs for x in p}), "id string")


def test_pagerank(spark):
    e, n = edges_of(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("a", "e")])
    names, links = "abcde", {"a": "be", "b": "c", "c": "a", "d": "a", "e": ""}
    r = dict.fromkeys(names, 0.2)
    for _ in range(100):
        lost = sum(r[x] for x in names if not links[x])
        r = {x: 0.03 + 0.85 * (sum(r[y] / len(links[y]) for y in names if x in links[y]) + lost / 5) for x in names}
    got = {x["id"]: x["rank"] for x in graph.pagerank(n, e, tol=1e-9).collect()}
    assert all(abs(got[x] - r[x]) < 1e-4 for x in names) and abs(sum(got.values()) - 1) < 1e-9


def test_components_and_cycles(spark):
    e, n = edges_of(spark, [(f"n{i:02}", f"n{i + 1:02}") for i in range(20)] + [("x", "y"), ("y", "x")])
    assert {r["component"] for r in graph.weak_components(n, e).collect()} == {"n00", "x"}
    assert [r["path"] for r in graph.cycles(e).collect()] == ["x > y"]


def test_bridges(spark):
    e, n = edges_of(spark, [("a", "b"), ("b", "c"), ("c", "d"), ("a", "e"), ("e", "c")])
    got = {r["id"]: r["score"] for r in graph.betweenness(n, e).collect()}
    assert abs(got["c"] - 3 / 12) < 1e-9 and abs(got["b"] - 1 / 12) < 1e-9 and got["d"] == 0


def test_bridges_do_not_end_early(spark):
    e, n = edges_of(spark, [("a", "b"), ("b", "c"), ("c", "d")])
    with pytest.raises(RuntimeError):
        graph.betweenness(n, e, rounds=2)
    assert graph.betweenness(n, e, rounds=3).count() == 4


def test_edits(spark):
    assert edit.unlink("see [[a/b|that]] and [[a/b]] `[[a/b]]` [[c]]", ["a/b"]) == "see that and b `[[a/b]]` [[c]]"
    assert edit.link_first("x `Title` Title and Title", "title", "t") == "x `Title` [[t|Title]] and Title"
    assert edit.mask_fences("a\n```\nb\n~~~\n```\nc") == "a\n```\n \n   \n```\nc"
    p = spark.createDataFrame([("p", "[[gone]] x")], "id string, content string")
    bad = spark.createDataFrame([("p", "gone")], "page string, target string")
    assert edit.fix_dead_links(p, bad).first()["content"] == "gone x"
    assert p.select(edit.nfc(F.lit("é"))).first()[0] == "é"


def test_mentions(spark):
    p = spark.createDataFrame([("a", "Deep Learning and learning"), ("b", "unlearning"), ("c", "see [[x]] learning")], "id string, content string")
    titles = spark.createDataFrame([("learning", "x"), ("deep learning", "y"), ("deep learning", "z"), ("+", "q"), ("see [[", "w")], "title string, target string")
    got = {r["id"]: r["target"] for r in edit.mentions(p, titles).collect()}
    assert got == {"a": "y"}
    many = spark.range(500).selectExpr("concat('word', id) AS title", "concat('t', id) AS target")
    said = spark.createDataFrame([("p", "word7, WORD499 and a\\E|b"), ("t3", "word3 Word12")], "id string, content string")
    assert {r["id"]: r["target"] for r in edit.mentions(said, many).collect()} == {"p": "t499", "t3": "t12"}
    odd = spark.createDataFrame([("a\\E|b", "o")], "title string, target string")
    assert [r["id"] for r in edit.mentions(said, odd).collect()] == ["p"]


def test_models(spark):
    assert models.salvage('talk ```json\n{"a": {"b": 1}}\n``` more') == {"a": {"b": 1}} and models.salvage("none") is None
    assert models.field_spec("key_points (list): the points # note") == ("key_points", True) and models.field_spec("title: x") == ("title", False)
    df = spark.createDataFrame([("hello",), (None,)], "prompt string")
    got = models.extract(df, "prompt", ["title", "tags (list): words"]).orderBy("prompt").collect()
    assert [r["title"] for r in got] == [None, "hello"]


def test_publish_filter(spark):
    rows = [("a", "stated", "retracted"), ("b", "stated", "contradicted"), ("c", "Speculative", "confirmed"), ("d", "stated", "confirmed"), ("e", None, None)]
    p = spark.createDataFrame(rows, "id string, confidence string, belief_state string")
    assert sorted(r["id"] for r in publish.kept(p).collect()) == ["d", "e"]


def test_chunks(spark):
    df = spark.createDataFrame([("g", i) for i in range(11)], "g string, i int")
    assert lint.chunked(df, "g", "i").count() == 10
    assert pd.Series(range(3)).sum() == 3


def test_wikilinks_of_whole_documents(spark, tmp_path):
    spark.createDataFrame([(1, "x " * 5000 + "[[Far/Away]] end"), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["links"] for r in scalars.t2(spark, str(tmp_path)).collect()}
    assert got == {1: "concepts/doc-1,plain,far/away", 2: "concepts/doc-2,plain"}
