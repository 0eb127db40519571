"""Tokenizers, language, pages, licences, shards and packing."""

import base64
import hashlib
import random
import zlib

import numpy as np
import pytest

from lodestar.llm import bpe, html_extract, langid, license_scan, packing, sharding

public = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    with open(public.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts(n=3000):
    rng = random.Random(2)
    parts = [" ", "  ", "\n", "\t", "a", "b1", "don't", "é", "12", "!?", "\U0001f600", "\r\n", " \n", " ", "word", "<|endoftext|>"]
    return ["", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaa" * 20] + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(n)]


def test_perfect_hash():
    keys = [f"k{i}".encode() for i in range(5000)]
    h = bpe.PerfectHash(keys)
    assert sorted(h.slots) == list(range(5000))
    assert all(h.slots[h.slot(k)] == i for i, k in enumerate(keys))


def test_ids_equal_and_round_trip(reference):
    own = bpe.tokenizer()
    for text in odd_texts():
        ids = own.encode(text)
        assert ids == reference.encode_ordinary(text)
        assert own.decode(ids) == text.encode()


def test_bpe_frames(spark, sf, reference):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "Hello there, world"), (3, "Hello there, world")], "doc_id long, text string")
    rows = {r["doc_id"]: r["ids"] for r in bpe.encode(docs).collect()}
    assert rows == {1: [], 2: [], 3: reference.encode_ordinary("Hello there, world")}
    texts = {r[0]: r[1] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    for r in bpe.op5_bpe(spark, sf).collect():
        ids = reference.encode_ordinary(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def check_packed(rows, expected, capacity):
    """expected: ids by document with their end."""
    by_doc, by_bin = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_bin.setdefault(r["sequence_id"], []).append(r)
    for d, ids in expected.items():
        own = sorted(by_doc[d], key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own))) and sum(r["length"] for r in own) == len(ids)
        for r in own:
            assert zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) == r["ids_crc32"]
        assert len(own) == -(-len(ids) // capacity)
    for own in by_bin.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    return len(by_bin)


def test_packing(spark, sf, reference):
    texts = {r[0]: r[1] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    expected = {d: reference.encode_ordinary(t) + [2] for d, t in texts.items()}
    bins = check_packed(packing.op10_packing(spark, sf).collect(), expected, 1024)
    assert bins <= 1.02 * -(-sum(map(len, expected.values())) // 1024) + 1


def test_packing_levels_and_odd_rows(spark, monkeypatch, reference):
    monkeypatch.setattr(packing, "GROUP", 80)
    rng = random.Random(3)
    texts = {i: " ".join("word" for _ in range(rng.randint(0, 40))) for i in range(300)} | {300: None, 301: "", 302: "a b c"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    expected = {d: reference.encode_ordinary(t or "") + [2] for d, t in texts.items()}
    bins = check_packed(packing.pack(docs, capacity=32).collect(), expected, 32)
    assert bins <= 1.1 * sum(map(len, expected.values())) / 32 + 1
    assert packing.pack(docs.where("false")).count() == 0


def test_best_fit():
    assert len(set(packing.best_fit(np.array([6, 4, 5, 5, 7, 3]), 10).tolist())) == 3


def test_language_held_out(spark, sf):
    rows = langid.op6_langid(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.95


def test_language_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "123 ... !", 5), (4, "b", 5), (5, "der die das und " * 400_000, 5)], "doc_id long, text string, SCORE int")
    model = (["de", "en"], np.log(np.full((2, langid.PLACES), 1 / langid.PLACES, np.float32)))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(docs, model).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0) and got[4][0] in ("de", "en") and 0 <= got[5][1] <= 1
    nothing = langid.train(docs.withColumn("lang", docs.text).where("false"))
    assert {r["lang_pred"] for r in langid.identify(docs, nothing).collect()} == {"und"}


def test_mixture_is_found():
    rng = np.random.default_rng(1)
    p = rng.dirichlet(np.full(langid.PLACES, 0.01), 3)
    gram = np.arange(langid.PLACES)
    count = rng.multinomial(3000, 0.6 * p[0] + 0.4 * p[2])
    at = np.flatnonzero(count)
    best, share = langid.infer(np.zeros(len(at), int), gram[at], count[at], np.log(p + 1e-9).astype(np.float32), 1)
    assert best[0] == 0 and abs(share[0] - 0.6) < 0.1


@pytest.fixture(scope="module")
def crf():
    return html_extract.default_model()


def test_pages_of_unseen_layouts(crf):
    right = [html_extract.main_text(p, crf) == "\n".join(k) for p, k in html_extract.labelled_pages(150, seed=77)]
    assert np.mean(right) > 0.9


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(5)
    for _ in range(50):
        e, t = rng.standard_normal((5, 2)), rng.standard_normal((2, 2))
        paths = [[(k >> i) & 1 for i in range(5)] for k in range(32)]
        score = lambda y: sum(e[i, y[i]] for i in range(5)) + sum(t[y[i - 1], y[i]] for i in range(1, 5))
        assert html_extract.viterbi(e, t).tolist() == max(paths, key=score)


def test_page_frames(spark, crf):
    page = "<html><head><title>T</title></head><body><nav><a href=/>Home</a></nav><article><h1>Title  &amp; more</h1><p>First\n words here.<p>Second words &eacute;.<script>var x='</p>';</script></article><footer>&copy; us</footer>"
    df = spark.createDataFrame([(1, "u", page, 3), (2, None, None, 3), (3, "u", "", 3)], "page_id long, url string, html string, TEXT int")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_extract.extract(df, crf).collect()}
    text = "Title & more\nFirst words here.\nSecond words é."
    assert got == {1: (text, len(text)), 2: ("", 0), 3: ("", 0)}
    assert html_extract.extract(df.where("false"), crf).count() == 0


def test_licenses(spark):
    rows = [
        (1, "Code.\nReleased under the MIT License.", "a/b/x.py"), (2, "nothing", "a/b/y.py"), (3, "Licensed under the Apache License, Version 2.0.", "a/LICENSE"),
        (4, "This work is licensed under the GNU General Public License, version 3.", "a/b/c/COPYING"), (5, None, "a/b/c/d/z"), (6, "", "q/z"), (7, "no path", None), (8, "the license to kill is not a notice of any sort that we know of", "a/n.txt"),
    ]
    got = {r["doc_id"]: (r["license"], r["origin"]) for r in license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string, path string")).collect()}
    assert got == {1: ("MIT", "a/b/x.py"), 2: ("Apache-2.0", "a/LICENSE"), 3: ("Apache-2.0", "a/LICENSE"), 4: ("GPL-3.0", "a/b/c/COPYING"), 5: ("GPL-3.0", "a/b/c/COPYING"), 6: (None, None), 7: (None, None), 8: ("Apache-2.0", "a/LICENSE")}
    assert license_scan.license_scan(spark.createDataFrame([], "doc_id long, text string, path string")).count() == 0


def test_licenses_weigh_common_terms_by_their_frequency(spark):
    notice = "This file is licensed under the Apache License, Version 2.0."
    for n in (40, 4000):  # a quarter of all notices, in a small table and in a large one
        rows = [(k, notice if k % 4 == 0 else f"the license of word{k} and thing{k}") for k in range(n)]
        got = license_scan.own_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert {(r["license"], round(r["score"], 2)) for r in got} == {("Apache-2.0", 0.8)} and len(got) == n // 4


def test_licenses_of_short_lines_of_several_sentences(spark):
    short = [("Part of the Foo project. Released under the MIT License.", "MIT"), ("Copyright 2021 Acme. All rights reserved.", "proprietary")]
    split = ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "MPL-2.0")  # no sentence ends after v.
    long = ("We wrote this project for ourselves and for all our friends, and it took us many more years than we had thought. Released under the MIT License.", "MIT")
    rows = [(k, *x) for k, x in enumerate([*short, split, long])] + [(k, f"the license of word{k} and thing{k}", None) for k in range(4, 100)]
    got = {r["id"]: (r["license"], round(r["score"], 6)) for r in license_scan.own_licenses(spark.createDataFrame(rows, "doc_id long, text string, want string")).collect()}
    assert got == {k: (want, 1.0) for k, _, want in rows if want}


def test_shards(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = sharding.op8_sharding(spark, sf).collect()
    rows = {r["doc_id"]: r for r in docs.collect()}
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r)
        raw = (rows[r["doc_id"]]["text"] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 8, zlib.crc32(raw))
    assert len(got) == len(rows) and set(by) == set(range(24))
    assert all(sorted(r["slot"] for r in b) == list(range(len(b))) for b in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1


def test_shards_follow_the_mixture(spark):
    docs = spark.range(12_000).selectExpr("id AS doc_id", "CAST(id AS string) AS text", "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 3 = 1 THEN NULL ELSE concat('s', id % 4) END AS source")
    got = sharding.shard(docs).join(docs.select("doc_id", "source"), "doc_id").collect()
    for k in range(24):
        own = [r for r in got if r["shard"] == k]
        for s, n in (("hot", 4000), (None, 4000), ("s0", 1000), ("s1", 1000)):
            assert abs(sum(r["source"] == s for r in own) - n / 24) <= 2
    few = spark.createDataFrame([(1, None, None), (1, None, None), (None, "", "x")], "doc_id long, text string, source string")
    assert sorted(r["slot"] for r in sharding.shard(few).collect()) == [0, 0, 0]
    assert sharding.shard(few.where("false")).count() == 0


def test_words_encoded_together(reference):
    own = packing._tokenizer(public.path("byte_bpe_50k.json"))
    words = list(dict.fromkeys(w for t in odd_texts() for w in t.split(" ")))
    got = dict(packing._word_ids(own, packing._opening(own), words, 7))
    assert {w: np.frombuffer(b, "<u4").tolist() for w, b in got.items()} == {w: reference.encode_ordinary(" " + w) for w in words}
