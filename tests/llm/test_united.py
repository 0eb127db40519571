"""Components whose edges are united inside tasks."""

import numpy as np

from lodestar.llm import common
from lodestar.llm.common import components, united


def _plain(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {x: find(x) for x in root}


def test_united_edges_lead_to_the_smallest_node():
    rng = np.random.default_rng(4)
    for n, m in ((1, 1), (40, 20), (300, 280), (300, 900)):
        u, v = rng.integers(0, n, m), rng.integers(0, n, m)
        nodes, roots = united(u, v)
        plain = _plain(zip(u.tolist(), v.tolist()))
        assert dict(zip(nodes.tolist(), roots.tolist())) == {x: r for x, r in plain.items() if x != r}


def test_few_edges_take_few_jobs_and_many_take_rounds(spark, monkeypatch):
    rng = np.random.default_rng(5)
    edges = [(i, i + 1) for i in range(600)] + [(int(a), int(b)) for a, b in rng.integers(1000, 2000, (500, 2))]
    want = {x: r for x, r in _plain([e for e in edges if e[0] != e[1]]).items()}
    df = spark.createDataFrame(edges, "a long, b long").repartition(7)
    sc = spark.sparkContext
    sc.setJobGroup("few", "few")
    got = {r["node"]: r["component"] for r in components(df).collect()}
    jobs = len(sc.statusTracker().getJobIdsForGroup("few"))
    sc.setJobGroup("rest", "rest")
    assert got == want and jobs <= 6  # a round for each doubling of the path took far more
    monkeypatch.setattr(common, "UNITED", 16)  # more than one task may end
    assert {r["node"]: r["component"] for r in components(df).collect()} == want
