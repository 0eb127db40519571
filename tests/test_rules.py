"""Citations, proposal files, limits over segments, cycles, bridges and slugs, against plain Python."""

import itertools
import random
from collections import defaultdict, deque

import pytest
from pyspark.sql import functions as F

from lodestar.functions import text
from lodestar.operators import augment, graph, lint, records


def cited(spark, s):
    return [tuple(c) for c in spark.createDataFrame([(s,)], "t string").select(text.citations("t")).first()[0]]


def test_citations_by_form_and_path(spark):
    assert [c[:2] for c in cited(spark, "a [source: concepts/a] b [ref: papers/b] c [[raw/x.md]] [source: raw/y] [ref:papers/b]")] == [("wiki", "concepts/a"), ("raw", "papers/b"), ("raw", "raw/x.md"), ("raw", "raw/y")]
    # one path of both kinds; the first context stays
    both = cited(spark, "see [[p]] once, [source: p] twice and [ref: p]")
    assert [c[:2] for c in both] == [("wiki", "p"), ("raw", "p")] and both[0][2] == "see [[p]] once, [source: p] twice and [ref: p]"
    for bad in ("[[../x]]", "[[/x]]", "[[a//b]]", "[[.env]]", "[[raw/.env]]", "[[x/]]", "[source: ]", "[source: a b]", "[[a|b]]", "[[]]", "[cite: x]"):
        assert cited(spark, f"x {bad} y") == []
    assert [c[1] for c in cited(spark, "[[raw/articles/foo.env.md]] [[größe/ß-1]]")] == ["raw/articles/foo.env.md", "größe/ß-1"]
    long = "b" * 30 + " " + "a" * 60 + "[[x]]" + "c" * 49 + " " + "d" * 9
    assert cited(spark, long)[0][2] == "a" * 50 + "[[x]]" + "c" * 49
    assert cited(spark, "\n [[x]]\n\t")[0][2] == "[[x]]" and cited(spark, None) == [] and cited(spark, "") == []


def test_proposal_files(spark):
    rows = [("run-12345678", 2, "entities/a", "Two\nlines", "propose", ["https://a.org/1", "https://a.org/2"], "because\r\nso"), ("run-12345678", 1, "entities/b", "B", "abstain", [], None)]
    files = augment.proposal_files(spark.createDataFrame(rows, "run string, nth int, id string, title string, action string, urls array<string>, reason string"), "2025-01-15T00:00:00+00:00")
    assert files.first()["text"] == (
        "# Augment Proposals - run `run-1234`\nGenerated: 2025-01-15T00:00:00+00:00\n\nReview each proposal below; run `kb lint --augment --execute` to fetch + save to `raw/`.\n\n"
        "## 1. entities/b\n- **Title:** B\n- **Action:** abstain\n- **Reason:** \n\n"
        "## 2. entities/a\n- **Title:** Two lines\n- **Action:** propose\n- **URLs:**\n  - https://a.org/1\n  - https://a.org/2\n- **Rationale:** because so\n"
    )
    back = [tuple(r) for r in augment.proposals_of(files).select("run", "id", "title", "action", "urls", "rationale", "reason").collect()]
    assert back == [("run-12345678", "entities/b", "B", "abstain", [], None, ""), ("run-12345678", "entities/a", "Two lines", "propose", ["https://a.org/1", "https://a.org/2"], "because so", None)]


def test_malformed_proposals(spark):
    odd = """text before
- **Title:** of nothing
## 1. no title
- **Action:** abstain
## 2. no urls
- **Title:** x
- **Action:** propose
- **URLs:**
## no number
- **Title:** stays with 2
##  3.  spaced id
-  **Title:**  First
- **Title:** Last
 - **Action:** indented
- **Action:** propose
- **URLs:**
  - https://a.org/x\t
   - https://three-blanks.org
  - https://too.late
- **Rationale:**"""
    got = augment.proposals_of(spark.createDataFrame([(1, odd), (2, None), (3, "")], "k int, text string")).drop("text").collect()
    assert [tuple(r) for r in got] == [(1, "spaced id", "Last", "propose", ["https://a.org/x"], "", None)]


@pytest.mark.parametrize("by", [["key"], [], ["key", "zone"]])
def test_limits_over_segments(spark, by):
    rng, calls, at = random.Random(7), [], 0
    for i in range(300):
        at += rng.choice([0, 1, 7, 40, 90, 101, 500])
        calls.append((rng.choice(["a", "b", None]), rng.randrange(2), i, at))
    df = spark.createDataFrame(calls, "key string, zone int, entry long, at long")
    got = {r["entry"]: r["accepted"] for r in records.limited(df, 2, 100, by).collect()}
    live, want = defaultdict(deque), {}
    for key, zone, i, at in calls:
        q = live[tuple({"key": key, "zone": zone}[c] for c in by)]
        while q and q[0] < at - 100:
            q.popleft()
        want[i] = len(q) < 2
        if want[i]:
            q.append(at)
    assert got == want
    cut = records.segments(df, 100, [])
    assert cut.select("segment").distinct().count() == 1 + sum(b[3] - a[3] > 100 for a, b in itertools.pairwise(calls))


def test_a_runs_limit_holds_across_segments(spark):
    rng, calls, at = random.Random(9), [], 0
    for i in range(240):
        at += rng.choice([0, 3, 30, 150])
        calls.append((rng.choice([1, 2, 3, None]), f"h{rng.randrange(3)}", i, at))
    got = {r["entry"]: (r["accepted"], r["retry"]) for r in augment.fetch_limited(spark.createDataFrame(calls, "run int, host string, entry long, at long"), 3, 2, 12, 100).collect()}
    every, hosts, runs, want = deque(), defaultdict(deque), defaultdict(int), {}
    for run, host, i, at in calls:
        for q in (every, hosts[host]):
            while q and q[0] < at - 100:
                q.popleft()
        full = every if len(every) >= 3 else hosts[host] if len(hosts[host]) >= 2 else None
        ok = runs[run] < 12 and full is None
        want[i] = (ok, 0 if runs[run] >= 12 or full is None else max(1, full[0] + 100 - at + 1))
        if ok:
            every.append(at)
            hosts[host].append(at)
            runs[run] += 1
    assert got == want and sum(ok for ok, _ in want.values()) == 48


def graph_of(spark, pairs):
    return spark.createDataFrame(pairs, "src string, dst string"), spark.createDataFrame([(x,) for x in sorted({x for p in pairs for x in p})], "id string")


def random_pairs(seed, n, m):
    rng = random.Random(seed)
    return sorted({(f"n{a:02}", f"n{b:02}") for a, b in ((rng.randrange(n), rng.randrange(n)) for _ in range(m)) if a != b})


def test_components_and_cycles_of_any_length(spark):
    pairs = random_pairs(4, 12, 22) + [(f"r{i}", f"r{(i + 1) % 6}") for i in range(6)] + [("r0", "n00")]
    out = defaultdict(set)
    for a, b in pairs:
        out[a].add(b)

    def reach(x):
        seen, todo = set(), [x]
        while todo:
            for y in out[todo.pop()] - seen:
                seen.add(y)
                todo.append(y)
        return seen

    far = {x: reach(x) for x in {x for p in pairs for x in p}}
    want = {x: min(y for y in far[x] if x in far[y]) for x in far if x in far[x]}
    e, _ = graph_of(spark, pairs)
    assert {r["id"]: r["component"] for r in graph.strong_components(e).collect()} == want
    found, walks = [], [(a, b) for a, b in pairs if a < b]
    while walks:
        found += [(len(w), " > ".join(w)) for w in walks if w[0] in out[w[-1]]]
        walks = [(*w, y) for w in walks for y in out[w[-1]] if y > w[0] and y not in w]
    found.sort()
    assert max(n for n, _ in found) >= 6 and len(found) >= 3
    assert sorted(map(tuple, graph.cycles(e).collect())) == found
    assert [tuple(r) for r in graph.cycles(e, most=2).collect()] == [*found[:2], (0, "__truncated__")]
    assert graph.cycles(e.where("false")).collect() == []


def test_bridges_by_batches_and_pivots(spark):
    pairs = random_pairs(5, 10, 24)
    e, n = graph_of(spark, pairs)
    names, out = [r["id"] for r in n.collect()], defaultdict(list)
    for a, b in pairs:
        out[a].append(b)

    def shares(root):
        far, paths, order = {root: 0}, {root: 1.0}, [root]
        for x in order:
            for y in out[x]:
                if y not in far:
                    far[y], paths[y] = far[x] + 1, 0.0
                    order.append(y)
                if far[y] == far[x] + 1:
                    paths[y] += paths[x]
        part = dict.fromkeys(order, 0.0)
        for x in reversed(order):
            for y in out[x]:
                if far[y] == far[x] + 1:
                    part[x] += paths[x] / paths[y] * (1 + part[y])
        return {x: p for x, p in part.items() if x != root}

    k = len(names)
    every = {x: shares(x) for x in names}
    want = {x: sum(every[r].get(x, 0.0) for r in names) / ((k - 1) * (k - 2)) for x in names}
    got = {r["id"]: r["score"] for r in graph.betweenness(n, e, batch=5).collect()}
    assert all(abs(got[x] - want[x]) < 1e-12 for x in names)
    import hashlib

    some = sorted(names, key=lambda x: hashlib.md5(f"0:{x}".encode()).hexdigest())[:6]
    want = {x: sum(every[r].get(x, 0.0) for r in some) / ((k - 1) * (k - 2)) * k / 6 for x in names}
    got = {r["id"]: r["score"] for r in graph.betweenness(n, e, pivots=6, batch=4).collect()}
    assert all(abs(got[x] - want[x]) < 1e-12 for x in names)
    assert {r["score"] for r in graph.betweenness(n, e.where("false")).collect()} == {0.0}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def edited(rng, s):
    s = list(s)
    for _ in range(rng.randint(1, 4)):
        at, kind = rng.randrange(len(s)), rng.randrange(3)
        s[at : at + (kind != 0)] = [] if kind == 1 else [rng.choice("abcdef-")]
    return "".join(s) or "x"


def test_slugs_of_all_lengths(spark):
    rng = random.Random(11)
    ids = {"".join(rng.choice("abcdef-") for _ in range(rng.randint(4, 44))) for _ in range(140)}
    ids |= {edited(rng, x) for x in list(ids)} | {"common-prefix-" + x[:20] for x in list(ids)[:40]}
    got = {(r["id"], r["id2"], r["distance"]) for r in lint.alike_slugs(spark.createDataFrame([(x,) for x in ids], "id string")).collect()}
    assert got == {(a, b, d) for a, b in itertools.combinations(sorted(ids), 2) if abs(len(a) - len(b)) <= 3 and 1 <= (d := distance(a, b)) <= 3} and len(got) > 90


def test_candidates_do_not_grow_with_the_square(spark):
    rng = random.Random(1)
    made = lambda n: {"concepts/" + "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(24)) for _ in range(n)}
    for n in (2000, 8000):
        ids = made(n)
        near = {edited(rng, x) for x in list(ids)[: n // 20]} - ids
        count = lint.alike_candidates(spark.createDataFrame([(x,) for x in ids | near], "id string")).count()
        assert len(near) // 4 <= count <= 20 * len(near)
