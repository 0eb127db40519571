"""Line dedup, hard negatives and the Merkle manifest against plain Python, and odd rows."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.llm import hard_negatives, line_dedup, merkle

SPACE = " \t\n\x0b\x0c\r"
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
fold = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s)


def lines_brute(rows, least_docs, least_chars=1):
    keys = lambda t: [fold(x.strip(SPACE)) for x in (t or "").split("\n")]
    n = Counter(k for _, t in rows for k in set(keys(t)))
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x, k in zip(lines, keys(t)) if not (n[k] >= least_docs and len(k) >= least_chars)]
        out.append((d, len(lines), len(lines) - len(kept), sha("\n".join(kept)), "\n".join(kept)))
    return sorted(out, key=repr)


def test_lines_of_odd_rows(spark):
    rng = random.Random(5)
    pool = ["Menu", " menu\t", "MENU\x0b", " menu", "", "  ", "É", "é", "a b", "A B ", "x\ry", "end\r"] + [f"line {i}" for i in range(30)]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 12)))) for i in range(80)]
    rows += [(100, None), (101, ""), (102, "\n"), (103, "\n\n menu \n"), (None, "menu\nalone"), (104, "menu"), (104, "menu"), (104, "other menu"), (105, "menu\n" * 40_000 + "last")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("N_Dropped", F.lit("mine")).withColumn("more", F.lit(7))
    for least, chars in ((3, 1), (10, 1), (2, 5), (1, 0)):
        got = line_dedup.dedup_lines(docs, least, chars)
        assert got.columns == ["doc_id", "text", "more", "n_lines", "n_dropped", "kept_sha256", "kept_text"]
        assert sorted(map(tuple, got.select("doc_id", "n_lines", "n_dropped", "kept_sha256", "kept_text").collect()), key=repr) == lines_brute(rows, least, chars)


def test_lines_of_no_rows(spark):
    assert line_dedup.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("fanout", [2, 3, 5])
def test_runs_count_over_batches(spark, fanout):
    """Keys become common in any batch, before and after merges of several levels."""
    rng, want = random.Random(fanout), Counter()
    runs = line_dedup.LineRuns(spark, 6, buckets=4, fanout=fanout)
    for _ in range(11):
        batch = [(k, k + 1) for k in range(40) for _ in range(rng.choice([0, 0, 1, k // 10]))]
        want.update(batch)
        runs.add(spark.createDataFrame(batch, "h1 long, h2 long"))
        assert all(len(level) < fanout for level in runs.levels)
    assert {tuple(r) for r in runs.common().collect()} == {k for k, n in want.items() if n >= 6}
    tables = [n for kind in (runs.levels, runs.settled) for level in kind for n in level]
    # sorted runs: a file for each bucket, in the order of its keys
    assert tables and all(t.name.startswith("lodestar_run_") for t in spark.catalog.listTables() if t.name in tables)
    runs.drop()
    assert not {t.name for t in spark.catalog.listTables()} & set(tables)


def mined_brute(rows, k=5, m=10):
    q = [(i, lab, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, lab, v in rows if i is not None and lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a in sorted((x for x in q if x[0] % 100 == 0), key=lambda x: (x[0], x[1], x[2])):
        if a[0] in {x[0] for x in out}:
            continue
        dot = lambda c: sum(x * y for x, y in zip(a[2], c[2]))
        near = [(dot(c), c[0], c[1] == a[1]) for c in q if len(c[2]) == len(a[2]) and c[0] != a[0]]
        order = lambda x: (-x[0], x[1])
        for p, pid, _ in sorted((x for x in near if x[2]), key=order)[:k]:
            fits = sorted((x for x in near if not x[2] and 30 * p <= 100 * x[0] <= 90 * p), key=order)[:m]
            out += [(a[0], pid, r + 1, nid, p, s) for r, (s, nid, _) in enumerate(fits)]
    return sorted(out)


LONG = "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"


def mined(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").withColumn("Score", F.lit(1)).withColumn("slice", F.lit("x"))
    return sorted(map(tuple, hard_negatives.mine(df, lambda i: i % 100 == 0, F.col("label")).select(*LONG).collect()))


def test_negatives_of_odd_vectors(spark):
    rng = np.random.default_rng(3)
    unit = lambda n: (lambda v: (v / np.linalg.norm(v)).tolist())(rng.normal(size=n))
    rows = [(i, int(rng.integers(3)), unit(3)) for i in range(0, 900, 3)]
    rows += [(i, i % 2, [0.5, 0.5, 0.5]) for i in range(1000, 1100)]  # ties
    rows += [(i, i % 3, unit(2)) for i in range(2000, 2101, 5)] + [(3000, 0, []), (3001, 0, []), (3002, 1, []), (3003, 1, [])]
    rows += [(None, 0, unit(3)), (1200, None, unit(3)), (1300, 1, None), (1400, 1, [1.0, None, 0.0]), (1500, 1, [float("nan"), 0.0, 1.0]), (1600, 1, [float("inf"), 0.0, 1.0]), (1700, 0, [0.0, 0.0, 0.0])]
    rows += [(4000, 1, [300.0, -2.0, 1.5]), (4001, 1, [250.0, 0.0, 0.0]), (4002, 0, [200.0, 9.0, 0.0])]
    assert mined(spark, rows) == mined_brute(rows)


def test_negatives_across_slices(spark, monkeypatch):
    """Small buckets, slices and blocks: norms differ, so that buckets are left out, and every limit is met."""
    for name, value in (("BUCKET", 16), ("BLOCK", 3)):
        monkeypatch.setattr(hard_negatives, name, value)
    rng = np.random.default_rng(8)
    rows = [(i, int(rng.integers(4)), (rng.normal(size=4) * rng.exponential()).tolist()) for i in range(0, 3000, 5)]
    want = mined_brute(rows)
    assert mined(spark, rows) == want and len(want) > 500


def test_a_bucket_under_every_limit_is_left_out(monkeypatch):
    search = hard_negatives._Search(2, False)
    search.question(np.array([0]), np.array([1]), np.array([[3, 4]]), [np.array([1, 40, 100, -(2**63)])])
    search.begin()
    called = []
    monkeypatch.setattr(hard_negatives, "_product", lambda a, b: called.append(1) or a @ b.T)
    search.meet(np.array([5, 6]), np.array([0, 0]), np.array([[6, 8], [7, 7]]), 11.0)
    assert called == [1]
    search.settle()
    assert search.floor.tolist() == [49]  # the second best, 3 * 7 + 4 * 7
    search.meet(np.array([7]), np.array([0]), np.array([[5, 5]]), 7.2)  # 5 * 7.2 < 49
    assert called == [1]
    search.meet(np.array([4]), np.array([0]), np.array([[7, 7]]), 9.9)  # a tie of a smaller id
    assert search.result().to_pydict() == {"anchor_id": [0, 0], "nth": [1, 1], "id": [5, 4], "score": [50, 49]}


def test_large_components_are_exact():
    a, b = np.array([[2**40, 3]]), np.array([[2**20, 5], [2**40, 1], [-(2**40), 0]])
    assert hard_negatives._product(a, b).tolist() == [[2**60 + 15, 2**63 - 1, -(2**63)]]


def test_negatives_of_no_rows(spark):
    assert mined(spark, []) == []


def manifest_brute(rows):
    enc = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    groups, out = defaultdict(list), []
    for r in rows:
        d, source, lang, n, text = r
        forged = text is not None and d is not None and zlib.crc32(str(d).encode()) % 3 == 0
        leaf = sha("".join(map(enc, r)))
        groups[lang].append((d is not None, d or 0, leaf, sha("".join(map(enc, (d, source, lang, n, fold(text))))) if forged else leaf, d))

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([sha("".join(levels[-1][i : i + 8])) for i in range(0, len(levels[-1]), 8)])
        return levels

    def path(levels, i):
        for level in levels[:-1]:
            run = level[i // 8 * 8 : i // 8 * 8 + 8]
            yield "".join(run[: i % 8]), "".join(run[i % 8 + 1 :])
            i //= 8

    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: tree([leaf for _, _, leaf, _, _ in sorted(groups[x])]) for x in langs}
    top = tree([trees[x][-1][0] for x in langs]) if langs else []
    for k, x in enumerate(langs):
        for i, (_, _, leaf, false, d) in enumerate(sorted(groups[x])):
            steps = [*path(trees[x], i), *path(top, k)]
            h = false
            for a, b in steps:
                h = sha(a + h + b)
            out.append((d, leaf, trees[x][-1][0], top[-1][0], sha("".join(a + b for a, b in steps)), h, h == top[-1][0]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("langs", [1, 2, 30])
def test_manifest_of_odd_rows(spark, langs):
    rng = random.Random(langs)
    rows = [(i, f"src{i % 3}", f"l{rng.randrange(langs)}", i, f"Text É {i}" * rng.randint(1, 3)) for i in range(150)]
    rows += [(500, None, None, None, None), (501, "s", "only", 3, ""), (None, "s", "l0", 3, "No Id"), (502, "s", "l0", 2, "A"), (502, "s", "l0", 2, "A"), (502, "s", "l0", 1, "B"), (503, "s", "", 900_000, "Long " * 180_000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").withColumn("leaf", F.lit("mine")).withColumn("Root", F.lit(1))
    assert sorted(map(tuple, merkle.manifest(docs).collect()), key=repr) == manifest_brute(rows)


def test_manifest_of_one_row_and_none(spark):
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    one = [(7, "s", "en", 1, "A")]
    assert sorted(map(tuple, merkle.manifest(spark.createDataFrame(one, schema)).collect())) == manifest_brute(one)
    assert merkle.manifest(spark.createDataFrame([], schema)).collect() == []
