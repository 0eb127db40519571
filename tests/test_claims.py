"""Claims whose tokens are in every task, and claims that are joined, find the same sentences."""

import random

from lodestar.operators import records


def test_claims_in_place_are_those_joined(spark, monkeypatch):
    rng = random.Random(3)
    words = "alpha beta gamma delta epsilon zeta eta theta not never C++ rust".split()
    line = lambda n: ". ".join(" ".join(rng.choice(words) for _ in range(rng.randrange(0, 7))) for _ in range(n))
    claims = spark.createDataFrame([(i, line(3)) for i in range(12)] + [(12, ""), (13, None)], "claim long, text string")
    pages = spark.createDataFrame([(f"p{i}", line(rng.randrange(0, 30))) for i in range(60)] + [("none", None)], "id string, content string")
    here = records.contradictions(claims, pages)
    assert "Exchange" not in here._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(records, "CLAIMED", 5)
    there = records.contradictions(claims, pages)
    a, b = (sorted(tuple(r) for r in df.collect()) for df in (here, there))
    assert a == b and len(a) > 50 and here.dtypes == there.dtypes
    monkeypatch.setattr(records, "CLAIMED", 1000)
    assert records.contradictions(claims.where("claim = 12"), pages).collect() == []
