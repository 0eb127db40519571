"""Exact, passage, near-duplicate and vector operators against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.llm import embed_dedup, exact_dedup, minhash, suffix_dedup
from lodestar.llm.common import components

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = [(1, "Aa bÉ"), (2, "aA bé"), (3, "AA BÉ"), (4, None), (5, ""), (6, "aa bÉ"), (7, "x" * 5000), (8, "X" * 5000), (9, "Y")]
DOCS = "doc_id long, text string"


def frame(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


def supplied(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")


def exact_brute(rows):
    groups = {}
    for d, t in rows:
        groups.setdefault((t or "").translate(LOW), []).append(d)
    return {d: (max(ds), len(ds), d == max(ds), hashlib.sha256(k.encode()).hexdigest()) for k, ds in groups.items() for d in ds}


@pytest.mark.parametrize("make", ["odd", "supplied"])
def test_exact(spark, sf, make):
    df = frame(spark, ODD) if make == "odd" else supplied(spark, sf)
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in exact_dedup.exact_dedup(df).collect()}
    assert got == exact_brute([tuple(r) for r in df.collect()])


def test_exact_clashing_columns_empty_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a", "x", 7), (1, "a", "x", 7), (None, "a", None, None)], "doc_id long, text string, KEPT string, group_size int")
    rows = exact_dedup.exact_dedup(df).collect()
    assert [r["keep_id"] for r in rows] == [1, 1, 1] and all(r["group_size"] == 3 for r in rows)
    assert exact_dedup.exact_dedup(df.where("false")).count() == 0
    assert exact_dedup.survivors(df).columns == df.columns


def passages_brute(rows, width=50):
    first = {}
    for d, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        for i in range(len(b) - width + 1):
            first.setdefault(b[i : i + width], d)
    out = {}
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - width + 1):
            if first[b[i : i + width]] < d:
                gone[i : i + width] = True
        runs = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out[d] = (len(b), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest())
    return out


PASSAGES = [(50, "a" * 300), (51, "b" * 40 + "a" * 200), (52, None), (53, ""), (54, "é" * 100), (55, "xé" + "é" * 70), (56, "ab" * 100), (57, "ba" * 60), (58, "q" * 49), (59, "q" * 49)]


def test_passages(spark, sf):
    rng = random.Random(4)
    common = ["".join(rng.choice("abcdef ") for _ in range(rng.randint(45, 160))) for _ in range(12)]
    mixed = [(100 + i, "".join(rng.choice([rng.choice(common), "".join(rng.choice("ghij ") for _ in range(rng.randint(1, 70)))]) for _ in range(4))) for i in range(40)]
    rows = PASSAGES + mixed
    got = {r["doc_id"]: tuple(r)[1:5] for r in suffix_dedup.repeated_passages(frame(spark, rows)).collect()}
    assert got == passages_brute(rows)
    assert suffix_dedup.repeated_passages(frame(spark, [])).count() == 0


def test_passages_of_supplied_documents(spark, sf):
    rows = [tuple(r) for r in supplied(spark, sf).collect()]
    assert {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.op3_suffix(spark, sf).collect()} == passages_brute(rows)


def test_passages_of_odd_rows(spark):
    """Null ids give and take nothing, rows of equal id nothing to each other; other columns are not read."""
    p, q = "p" * 20 + "passage one, long enough to be found again" + "z" * 10, "another passage, of fifty bytes and some more of them"
    rows = [(None, p, 1), (None, p, 2), (1, "x " + p, 3), (1, "y " + p, 4), (2, p + " end", 5), (2, p + " end", 5), (3, q, 6), (3, "a" + q, 7), (4, None, 8), (4, q + "!", 9)]
    got = suffix_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string, N_BYTES int")).collect()
    seen = sorted((r["doc_id"] or 0, r["n_bytes"], r["n_removed"]) for r in got)
    assert seen == sorted([(0, len(p), 0)] * 2 + [(1, len(p) + 2, 0)] * 2 + [(2, len(p) + 4, len(p))] * 2 + [(3, len(q), 0), (3, len(q) + 1, 0), (4, 0, 0), (4, len(q) + 1, len(q))])


def test_passages_of_hot_minimisers(spark, sf, monkeypatch):
    """Minimisers that many documents have are dealt in parts."""
    monkeypatch.setattr(suffix_dedup, "SAMPLED", 1)
    monkeypatch.setattr(suffix_dedup, "HOT", 12)
    monkeypatch.setattr(suffix_dedup, "PARTS", 5)
    rng = random.Random(21)
    common = "".join(rng.choice("abcdefgh ") for _ in range(150))
    rows = []
    for i in range(300):
        a, b = sorted(rng.sample(range(151), 2))
        rows.append((i, "".join(rng.choice("ijkl ") for _ in range(rng.randint(0, 40))) + common[a:b] + "".join(rng.choice("mnop ") for _ in range(rng.randint(0, 40)))))
    rows += [(1000 + r["doc_id"], r["text"]) for r in supplied(spark, sf).limit(100).collect()]
    df = frame(spark, rows).repartition(9)
    docs = df.select(F.col("doc_id").alias("id"), "text")
    assert len(suffix_dedup._hot(docs, 50, 0)) > 3
    got = {r["doc_id"]: tuple(r)[1:5] for r in suffix_dedup.repeated_passages(df).collect()}
    assert got == passages_brute(rows)


def test_passages_through_files(spark, monkeypatch):
    """Columns beyond memory are files of the shared folder; results are the same and nothing is left there."""
    import glob

    rng = random.Random(12)
    shared = "".join(rng.choice("ab") for _ in range(400))
    texts = [shared[: rng.randint(60, 400)] + "".join(rng.choice("abc") for _ in range(60)) for _ in range(12)]
    pieces = [t.encode()[i : i + 90] for t in texts for i in range(0, len(t) - 50, 7)]
    args = np.frombuffer(b"".join(pieces), np.uint8), np.array([len(p) for p in pieces])
    want = np.concatenate([*suffix_dedup.collection(*args)])
    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file:") + "/columns"
    monkeypatch.setattr(suffix_dedup, "IN_MEMORY", 500)
    monkeypatch.setattr(suffix_dedup, "BLOCK", 300)
    assert (np.concatenate([*suffix_dedup.collection(*args, folder)]) == want).all()
    assert glob.glob(folder + "/*") == []


def test_suffix_array():
    rng = random.Random(1)
    for _ in range(40):
        pieces = [bytes(rng.choice(b"ab\x00") for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(1, 12))]
        who, size, prefix = suffix_dedup.build(pieces)
        every = sorted((p[len(p) - k :], i) for i, p in enumerate(pieces) for k in range(len(p) + 1))
        assert [pieces[w][len(pieces[w]) - int(s) :] for w, s in zip(who, size)] == [s for s, _ in every]
        shared = [0] + [next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b))) for (a, _), (b, _) in zip(every, every[1:])]
        assert prefix.tolist() == shared


def near_brute(rows, width=4):
    sets = {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
        sets[d] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), root(d), root(d) == d) for d in ids}


def copies(seed=5, n=40):
    rng = random.Random(seed)
    rows, d = [(0, None), (1, ""), (2, " \t "), (3, "One two"), (4, "one  TWO"), (5, "one two three")], 10
    for _ in range(n):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.choice([4, 6, 12, 40, 200]))]
        for _ in range(rng.randint(1, 5)):
            own = list(words)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                own[rng.randrange(len(own))] = f"x{rng.randrange(10**6)}"
            rows.append((d, " ".join(own)))
            d += 1
    return rows


def test_near(spark, monkeypatch):
    rows = copies()
    got = {r["doc_id"]: tuple(r)[1:] for r in minhash.near_dedup(frame(spark, rows), width=4).collect()}
    assert got == near_brute(rows)
    assert minhash.near_dedup(frame(spark, [])).count() == 0


def test_near_in_blocks(spark, monkeypatch):
    """Groups larger than a block are linked over all their blocks."""
    monkeypatch.setattr(minhash, "BLOCK", 8)
    monkeypatch.setattr(minhash, "EXACT", 8)
    rng = random.Random(8)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(60):
        own = list(base)
        for _ in range(rng.randint(0, 7)):
            own[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(own)))
    got = {r["doc_id"]: tuple(r)[1:] for r in minhash.near_dedup(frame(spark, rows), width=4).collect()}
    assert got == near_brute(rows)


def test_near_in_blocks_of_many_groups(spark, monkeypatch):
    """Loose groups of several linked ones, with buckets and heads beyond a block."""
    monkeypatch.setattr(minhash, "BLOCK", 4)
    monkeypatch.setattr(minhash, "EXACT", 4)
    monkeypatch.setattr(minhash, "PLAUSIBLE", 400)
    rng, rows = random.Random(9), []
    base = [f"w{i}" for i in range(60)]
    for g in range(12):
        own = list(base)
        for k in range(0, 60, 5):
            if rng.random() < 0.35:
                own[k] = f"g{g}x{k}"
        for i in range(6):
            one = list(own)
            one[rng.randrange(60)] = f"y{g}{i}"
            rows.append((g * 10 + i, " ".join(one)))
    got = {r["doc_id"]: tuple(r)[1:] for r in minhash.near_dedup(frame(spark, rows), width=4).collect()}
    assert got == near_brute(rows)


def test_near_odd_rows(spark):
    same = " ".join(f"w{i}" for i in range(30))
    rows = [(None, same, "x"), (5, same, "x"), (5, "other words that stand here", "y"), (6, "other words that stand here", "z"), (7, "w " * 200_000, "z"), (8, "w " * 200_001, None), (7, same, "q")]
    got = minhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string, KEPT string"), width=4).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in got) == [(0, 0, True), (5, 5, True), (5, 5, True), (6, 5, False), (7, 5, False), (7, 5, False), (8, 5, False)]


def test_near_of_supplied_documents(spark, sf):
    rows = [tuple(r) for r in supplied(spark, sf).collect()]
    assert {r["doc_id"]: tuple(r)[1:] for r in minhash.op4_minhash(spark, sf).collect()} == near_brute(rows)


def test_components(spark):
    rng = random.Random(2)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(150)] + [(1000 + i, 1001 + i) for i in range(30)]
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert all(root(x) == c for x, c in got.items())
    assert {x for a, b in pairs if a != b for x in (a, b)} == set(got)


def test_vectors(spark, sf):
    v = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding")
    rows = v.orderBy("vec_id").collect()
    x = np.stack([np.array(r["embedding"], np.float64) for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    true = (x @ x.T >= 0.9).sum(1) - 1
    got = {r["vec_id"]: r for r in embed_dedup.near_vectors(v).collect()}
    found = np.array([got[r["vec_id"]]["n_links"] for r in rows])
    assert (found <= true).all() and found.sum() >= 0.99 * true.sum()


def test_vectors_odd_rows(spark):
    rng = np.random.default_rng(3)
    a = rng.standard_normal(64)
    rows = [(1, a.tolist()), (2, (a * 2).tolist()), (3, a.tolist()), (4, None), (5, [0.0] * 64), (6, [float("nan")] * 64), (7, [None] + [1.0] * 63), (8, (-a).tolist()), (None, a.tolist()), (9, []), (10, (a * 1e-30).tolist())]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embed_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got[1] == (3, 1, True) and got[2] == (3, 1, False) and got[3] == (3, 1, False) and got[10] == (3, 1, False)
    assert all(got[k] == (0, k, True) for k in (4, 5, 6, 7, 8, 9)) and got[None] == (0, None, True)
    assert embed_dedup.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def pairs_of(rng, dim, n, cosine):
    """n pairs of unit vectors of a cosine, all else far apart where the dimensions allow it."""
    a, z = rng.standard_normal((2, n, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    z -= (z * a).sum(1, keepdims=True) * a
    return a, cosine * a + (1 - cosine**2) ** 0.5 * z / np.linalg.norm(z, axis=1, keepdims=True)


def test_vectors_of_any_dimension(spark):
    """All dimensions in one table, each against brute force on its own rows."""
    rng, rows, own = np.random.default_rng(4), [], {}
    for dim, n in ((3, 60), (16, 300), (64, 300), (128, 300), (384, 300), (1024, 200), (1073, 50), (2082, 50)):
        own[dim] = np.concatenate(pairs_of(rng, dim, n, 0.905))
        rows += [(dim * 10_000 + i, x.tolist()) for i, x in enumerate(own[dim])]
    got = {r["vec_id"]: r["n_links"] for r in embed_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(8)).collect()}
    true, found = 0, 0
    for dim, x in own.items():
        want = (x @ x.T / (np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(x, axis=1)) >= 0.9).sum(1) - 1
        mine = np.array([got[dim * 10_000 + i] for i in range(len(x))])
        assert (mine <= want).all() and mine.sum() >= 0.975 * want.sum(), dim
        true, found = true + want.sum(), found + mine.sum()
    assert found >= 0.985 * true


@pytest.mark.parametrize("dim", [8, 16, 32, 64, 128, 384, 1024])
def test_lists_stay_short(dim):
    unit = np.random.default_rng(6).standard_normal((40, dim))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    assert len(embed_dedup.all_listed(unit, embed_dedup.cap_for(dim, 0.9))[0]) <= 200 * 40


def test_every_vector_has_a_filter_of_each_rotation():
    unit = np.random.default_rng(5).standard_normal((50, 128))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    row, name = embed_dedup.all_listed(unit, 0.9)
    assert len(row) == 50 * embed_dedup.TURNS == len(set(zip(row, name % embed_dedup.TURNS)))
