"""Queries of ranked search."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import graph, retrieval
from ..session import shared_dir
from .adapters import AS_OF, PAGES, links, pages, table
from .registry import query
from .relations import EDGES, _pagerank_sql
from .scalars import tokens_sql

QUESTION = "inger heat ened tionin nter"


def _bm25_sql(title: bool) -> str:
    words = f"list_concat(list_concat({tokens_sql('title')}, {tokens_sql('title')}), list_concat({tokens_sql('title')}, {tokens_sql('content')}))" if title else tokens_sql("content")
    return f"""w AS (SELECT id, {words} AS words FROM pages_), d AS (SELECT id, len(words) AS dl, words FROM w), a AS (SELECT count(*) AS total, avg(dl) AS avgdl FROM d),
t AS (SELECT unnest(['{"', '".join(QUESTION.split())}']) AS term), h AS (SELECT id, dl, term, len(list_filter(words, lambda x: x = term)) AS tf FROM d, t), f AS (SELECT term, count(*) AS df FROM h WHERE tf > 0 GROUP BY 1),
score_ AS (SELECT id, sum(ln((total - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM h JOIN f USING (term), a WHERE tf > 0 GROUP BY 1)"""


@query("r1_bm25_search", f"WITH {PAGES}, {_bm25_sql(True)} SELECT id, round(score, 6) AS score FROM score_ ORDER BY round(score, 6) DESC, id LIMIT 10")
def r1(spark, sf):
    hits = retrieval.bm25(pages(spark, sf), QUESTION).withColumn("score", F.round("score", 6))
    return retrieval.top(hits, 10)


@query("r1_bm25_scores", f"WITH {PAGES}, {_bm25_sql(True)} SELECT id, round(score, 6) AS score FROM score_")
def r1_all(spark, sf):
    return retrieval.bm25(pages(spark, sf), QUESTION).select("id", F.round("score", 6).alias("score"))


_indexes: dict[tuple[str, str], str] = {}


def index_of(spark, sf) -> str:
    """The index of the pages, written once for each application below the shared folder."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _indexes:
        at = f"{shared_dir(spark)}/lodestar-index-{uuid.uuid4().hex}"
        retrieval.write_index(pages(spark, sf), at)
        _indexes[key] = at
    return _indexes[key]


@query("r1_indexed", f"WITH {PAGES}, {_bm25_sql(True)} SELECT id, round(score, 6) AS score FROM score_ ORDER BY round(score, 6) DESC, id LIMIT 10")
def r1_indexed(spark, sf):
    hits = retrieval.ask_index(spark, index_of(spark, sf), QUESTION).withColumn("score", F.round("score", 6))
    return retrieval.top(hits, 10)


@query("r2_raw_search", f"WITH {PAGES}, {_bm25_sql(False)} SELECT id, round(score, 6) AS score FROM score_ ORDER BY round(score, 6) DESC, id LIMIT 5")
def r2(spark, sf):
    hits = retrieval.bm25(pages(spark, sf), QUESTION, title=False).withColumn("score", F.round("score", 6))
    return retrieval.top(hits, 5)


@query("v3_nearest", "WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0) SELECT vec_id, round(distance, 5) AS distance FROM (SELECT vec_id, sqrt(list_sum(list_transform(list_zip(embedding, e), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) ** 2))) AS distance FROM embeddings, q) ORDER BY round(distance, 5), vec_id LIMIT 20")
def v3(spark, sf):
    v = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    return retrieval.nearest(v, v.where("vec_id = 0"), 20, 5).select("vec_id", "distance")


@query("r4_fusion", "WITH a AS (SELECT vec_id AS id, row_number() OVER (ORDER BY label, vec_id) - 1 AS r FROM embeddings), b AS (SELECT vec_id AS id, row_number() OVER (ORDER BY label DESC, vec_id) - 1 AS r FROM embeddings WHERE vec_id % 2 = 0) SELECT id, round(sum(1 / (60 + r)), 9) AS score FROM (FROM a UNION ALL FROM b) GROUP BY 1")
def r4(spark, sf):
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "label")
    a = graph.ranked(v, ["label", "id"])
    b = graph.ranked(v.where("id % 2 = 0"), [F.desc("label"), "id"])
    return retrieval.fused([a, b]).select("id", F.round("score", 9).alias("score"))


@query("p7_boosts", f"WITH {PAGES} SELECT id, round(CASE WHEN status IN ('mature', 'evergreen') THEN 1.05 ELSE 1 END * CASE WHEN authored_by IN ('human', 'hybrid') THEN 1.02 ELSE 1 END, 6)::DOUBLE AS score FROM pages_")
def p7(spark, sf):
    return retrieval.boosted(pages(spark, sf).withColumn("score", F.lit(1.0))).select("id", F.round("score", 6).alias("score"))


@query("r9_stale_flags", f"WITH {PAGES} SELECT id, DATE '{AS_OF}' - CAST(updated AS DATE) > 90 AS stale FROM pages_")
def r9(spark, sf):
    return retrieval.stale_flags(pages(spark, sf), AS_OF).select("id", "stale")


@query("r14_snippets", f"WITH {PAGES} SELECT id, replace(substr(content, 1, 200), chr(10), ' ') AS snippet FROM pages_")
def r14(spark, sf):
    return pages(spark, sf).select("id", F.translate(F.substring("content", 1, 200), "\n", " ").alias("snippet"))


@query("w3_two_a_page", "SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM events) WHERE r <= 2")
def w3(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("id"), F.col("value").alias("score"), F.col("event_id").alias("chunk"))
    return retrieval.per_page(e).select(F.col("chunk").alias("event_id"))


@query("w2_best_of_page", "SELECT user_id AS id, arg_max(event_id, (value, -event_id)) AS best FROM events GROUP BY 1")
def w2(spark, sf):
    return table(spark, sf, "events").groupBy(F.col("user_id").alias("id")).agg(F.max_by("event_id", F.struct("value", -F.col("event_id"))).alias("best"))


@query("a13_coverage", "WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0), d AS (SELECT vec_id, round(1 / (1 + sqrt(list_sum(list_transform(list_zip(embedding, e), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) ** 2)))), 4) AS s FROM embeddings, q) SELECT round(avg(s), 4) AS confidence, avg(s) < 0.45 AS low FROM d WHERE s >= 0.3")
def a13(spark, sf):
    from ..functions.dates import similarity

    v = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    s = retrieval.distances(v, v.where("vec_id = 0")).select(similarity("distance").alias("s")).where("s >= 0.3")
    return s.agg(F.round(F.avg("s"), 4).alias("confidence"), (F.avg("s") < 0.45).alias("low"))


#: Words that results are compared by, and the fold of results (k, id, type, words, score) from the best: alike ones of a type go, then types over their share.
_WORDS = "list_distinct(list_filter(regexp_split_to_array(lower(content), '\\s+'), lambda w: length(w) > 2))"
_FOLD = """near_ AS MATERIALIZED (SELECT a.k AS i, list(b.k) AS js FROM items_ a JOIN items_ b ON a.type = b.type AND b.k < a.k AND len(list_intersect(a.words, b.words)) / greatest(len(list_distinct(list_concat(a.words, b.words))), 1) > 0.85 GROUP BY 1),
c_ AS MATERIALIZED (SELECT k, type, coalesce(js, []::BIGINT[]) AS js FROM items_ LEFT JOIN near_ ON i = k),
a_(k, kept) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT c_.k, CASE WHEN len(list_intersect(kept, js)) > 0 THEN kept ELSE list_append(kept, c_.k) END FROM a_ JOIN c_ ON c_.k = a_.k + 1),
o_ AS MATERIALIZED (SELECT kept FROM a_ ORDER BY k DESC LIMIT 1), u_ AS MATERIALIZED (SELECT n.item, n.k, type FROM (SELECT unnest(kept) AS item, generate_subscripts(kept, 1) AS k FROM o_) n JOIN c_ ON c_.k = n.item),
b_(k, kept, types) AS (SELECT 0::BIGINT, []::BIGINT[], []::VARCHAR[] UNION ALL
  SELECT u_.k, CASE WHEN len(list_filter(types, lambda y: y = type)) >= greatest(1, ceil((len(types) + 1) * 0.6)) THEN kept ELSE list_append(kept, u_.item) END, CASE WHEN len(list_filter(types, lambda y: y = type)) >= greatest(1, ceil((len(types) + 1) * 0.6)) THEN types ELSE list_append(types, type) END FROM b_ JOIN u_ ON u_.k = b_.k + 1),
q_ AS MATERIALIZED (SELECT kept FROM b_ ORDER BY k DESC LIMIT 1), r_ AS (SELECT {'id': i.id, 'type': i.type, 'score': i.score} AS x, n.rank FROM (SELECT unnest(kept) AS item, generate_subscripts(kept, 1) - 1 AS rank FROM q_) n JOIN items_ i ON i.k = n.item)"""
_HITS = "hits_ AS (SELECT id, round(score, 6) AS score FROM score_ ORDER BY round(score, 6) DESC, id LIMIT {})"


def _search_sql() -> str:
    """BM25 and page rank over its candidates, fused, boosted, folded."""
    return f"""s1_ AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) - 1 AS r FROM (SELECT id, round(score, 4) AS score FROM score_) ORDER BY score DESC, id LIMIT 20),
s2_ AS (SELECT id, row_number() OVER (ORDER BY coalesce(round(rank, 12), 0) DESC, r) - 1 AS r FROM s1_ LEFT JOIN r20 USING (id)),
f_ AS (SELECT id, round(sum(1 / (60 + r)), 12) AS score FROM (FROM s1_ UNION ALL FROM s2_) GROUP BY 1 ORDER BY score DESC, id LIMIT 20),
h_ AS (SELECT id, type, content, score * CASE WHEN status IN ('mature', 'evergreen') THEN 1.05 ELSE 1 END * CASE WHEN authored_by IN ('human', 'hybrid') THEN 1.02 ELSE 1 END AS score FROM f_ JOIN pages_ USING (id)),
items_ AS MATERIALIZED (SELECT row_number() OVER (ORDER BY score DESC, id) AS k, id, type, {_WORDS} AS words, score::DOUBLE AS score FROM h_)"""


@query("r7_search", f"WITH RECURSIVE {EDGES}, {_pagerank_sql(20)}, {_bm25_sql(True)}, {_search_sql()}, {_FOLD} SELECT CAST(rank AS INT) AS rank, x.id AS id, x.type AS type, round(x.score, 6) AS score FROM r_ WHERE rank < 10")
def r7(spark, sf):
    p = pages(spark, sf)
    e = graph.edges(links(spark, sf), p)
    return retrieval.search(p, QUESTION, graph.pagerank(p, e, rounds=20, tol=0.0)).select("rank", "id", "type", F.round("score", 6).alias("score"))


@query("r8_dedup", f"WITH RECURSIVE {PAGES}, {_bm25_sql(True)}, {_HITS.format(200)}, items_ AS MATERIALIZED (SELECT row_number() OVER (ORDER BY score DESC, id) AS k, id, type, {_WORDS} AS words, score::DOUBLE AS score FROM hits_ JOIN pages_ USING (id)), {_FOLD} SELECT CAST(rank AS INT) AS rank, x.id AS id, x.type AS type FROM r_")
def r8(spark, sf):
    p = pages(spark, sf)
    hits = retrieval.top(retrieval.bm25(p, QUESTION).withColumn("score", F.round("score", 6)), 200).join(p, "id")
    return retrieval.deduped(hits).select("rank", "id", "type")


@query("r10_context", f"""WITH RECURSIVE {PAGES}, {_bm25_sql(True)}, {_HITS.format(60)}, l_ AS MATERIALIZED (SELECT row_number() OVER (ORDER BY CASE WHEN type = 'summary' THEN 0 ELSE 1 END, score DESC, id) AS k, id, type = 'summary' AS early, length(content) AS n FROM hits_ JOIN pages_ USING (id)),
c_(k, used, got) AS (SELECT 0::BIGINT, 0::BIGINT, []::STRUCT(id VARCHAR, taken BIGINT)[] UNION ALL
  SELECT l_.k, CASE WHEN NOT (early AND used + n > 12000 AND (len(got) > 0 OR n <= 80000)) AND used + n <= 80000 THEN used + n WHEN len(got) = 0 AND n > 80000 THEN 80000 ELSE used END,
    CASE WHEN NOT (early AND used + n > 12000 AND (len(got) > 0 OR n <= 80000)) AND used + n <= 80000 THEN list_append(got, {{'id': id, 'taken': n}}) WHEN len(got) = 0 AND n > 80000 THEN list_append(got, {{'id': id, 'taken': 80000::BIGINT}}) ELSE got END FROM c_ JOIN l_ ON l_.k = c_.k + 1),
g_ AS (SELECT unnest(got) AS x FROM (SELECT got FROM c_ ORDER BY k DESC LIMIT 1)) SELECT x.id AS id, x.taken AS taken FROM g_""")
def r10(spark, sf):
    p = pages(spark, sf)
    hits = retrieval.top(retrieval.bm25(p, QUESTION).withColumn("score", F.round("score", 6)), 60).join(p, "id")
    ranked = hits.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))
    return retrieval.context(ranked)
