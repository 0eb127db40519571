"""Further queries: validators, pairings, graph parts, hybrid search and edits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import dates, text
from ..operators import consistency, edit, graph, lint, publish, records, retrieval
from .adapters import AS_OF, FEEDBACK, LINKS, MANIFEST, PAGES, VERDICTS, events, feedback, links, manifest, pages, sources, table, verdicts
from .registry import query
from .relations import AUTO, DEGREES, DRIFT, EDGES, HIDDEN, TRUST, _T, graph_of
from .scalars import over_documents, sql_documents
from .searches import QUESTION, _bm25_sql

_COMMON = ", ".join(f"'{w}'" for w in consistency.COMMON)


@query("t11_purpose", sql_documents(digest="sha256(CASE WHEN trim(t) = '' THEN '' ELSE '<purpose>' || chr(10) || '</-purpose>' || substr(t, 1, 4084) || chr(10) || '</purpose>' END)"))
def t11(spark, sf):
    marked = F.when(F.trim("t") != "", F.concat(F.lit("< / Purpose>"), F.col("t"))).otherwise(F.col("t"))
    return over_documents(spark, sf, digest=F.sha2(text.wrapped_purpose(marked), 256))


@query("t16_overlap_terms", sql_documents(n=f"CAST(len(list_distinct(list_filter(list_transform(string_split(regexp_replace(lower(t), '\\s+', ' ', 'g'), ' '), lambda w: trim(w, '.,!?()[]{{}}\"'':-/')), lambda w: length(w) > 4 AND w NOT IN ({_COMMON})))) AS BIGINT)".replace("{{", "{").replace("}}", "}")))
def t16(spark, sf):
    return over_documents(spark, sf, n=F.size(text.overlap_terms("t", consistency.COMMON)).cast("long"))


@query("t33_fenced_off", sql_documents(digest="sha256('<\\/source> ''''''x' || replace(t, '```', ''''''''))"))
def t33(spark, sf):
    return over_documents(spark, sf, digest=F.sha2(text.fenced_off(F.concat(F.lit("</source> ```x"), F.col("t"))), 256))


@query("d3_longest_window", f"WITH {PAGES} SELECT id, CASE WHEN n % 2 = 0 THEN 1095 WHEN n % 3 = 0 THEN 180 ELSE 90 END AS days FROM pages_")
def d3(spark, sf):
    """Over the sources of each page."""
    refs = F.array(F.col("source"), F.when(F.col("n") % 2 == 0, "https://arxiv.org/x").otherwise(F.col("source")), F.when(F.col("n") % 3 == 0, "https://github.com/a/b").otherwise(""))
    return pages(spark, sf).select("id", dates.longest_window(refs).alias("days"))


@query("d4_dates", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE strftime(ts, '%Y-%m-%d') END AS day FROM events")
def d4(spark, sf):
    shown = F.when(F.col("event_id") % 3 == 0, "2024-13-45").otherwise(F.date_format("ts", "yyyy-MM-dd"))
    return events(spark, sf).select("event_id", F.date_format(F.try_to_date(shown), "yyyy-MM-dd").alias("day"))


@query("d8_idf", "SELECT l_partkey, round(ln((n - df + 0.5) / (df + 0.5) + 1), 6)::DOUBLE AS idf FROM (SELECT l_partkey, count(*) AS df FROM lineitem GROUP BY 1), (SELECT count(*) AS n FROM lineitem)")
def d8(spark, sf):
    """How rare every part is among the items of all orders."""
    lines = table(spark, sf, "lineitem")
    total = F.broadcast(lines.agg(F.count("*").alias("n")))  # one row
    return lines.groupBy("l_partkey").agg(F.count("*").alias("df")).join(total).select("l_partkey", F.round(dates.idf("n", "df"), 6).alias("idf"))


@query("p3_slug_faults", f"WITH {PAGES} SELECT id, CASE n % 4 WHEN 0 THEN 'climbs' WHEN 1 THEN 'reserved' WHEN 2 THEN 'control characters' END AS reason FROM pages_")
def p3(spark, sf):
    given = F.expr("CASE n % 4 WHEN 0 THEN concat('../', id) WHEN 1 THEN concat(id, '/con.md') WHEN 2 THEN concat(id, chr(7)) ELSE id END")
    return pages(spark, sf).select("id", lint.page_id_fault(given).alias("reason"))


@query("p4_feedback_faults", f"WITH {FEEDBACK} SELECT entry, CASE WHEN rating = 'incomplete' THEN 'unknown rating' WHEN entry % 10 = 0 THEN 'no question' WHEN entry % 10 = 1 THEN 'question too long' WHEN length(notes) > 2000 THEN 'notes too long' END AS reason FROM feedback_")
def p4(spark, sf):
    rating = F.when(F.col("rating") == "incomplete", "fair").otherwise(F.col("rating"))
    question = F.expr("CASE entry % 10 WHEN 0 THEN ' ' WHEN 1 THEN repeat('q', 2001) ELSE question END")
    return feedback(spark, sf).select("entry", lint.feedback_fault(rating, question, F.col("notes")).alias("reason"))


@query("p8_extractions", "SELECT event_id, props LIKE '{%' AS typed FROM events WHERE props IS NOT NULL")
def p8(spark, sf):
    parsed = F.from_json("props", "map<string,string>")
    return table(spark, sf, "events").where("props IS NOT NULL").select("event_id", parsed.isNotNull().alias("typed"))


@query("p10_input_sizes", "SELECT doc_id, strlen(text) <= 50000 AS fits FROM documents")
def p10(spark, sf):
    return table(spark, sf, "documents").select("doc_id", (F.octet_length("text") <= 50_000).alias("fits"))


@query("p11_run_ids", "SELECT event_id, event_id % 2 = 0 AS fine FROM events")
def p11(spark, sf):
    given = F.when(F.col("event_id") % 2 == 0, F.substring(F.sha2(F.col("event_id").cast("string"), 256), 1, 8)).otherwise(F.concat(F.lit("../"), F.col("event_id").cast("string")))
    return table(spark, sf, "events").select("event_id", lint.run_id_fault(given).isNull().alias("fine"))


@query("j3_broken_by_page", f"WITH {LINKS} SELECT src, count(*) AS broken FROM links_ WHERE target NOT IN (SELECT id FROM pages_) GROUP BY 1")
def j3(spark, sf):
    return lint.dead_links(links(spark, sf), pages(spark, sf)).groupBy(F.col("page").alias("src")).agg(F.count("*").alias("broken"))


@query("j9_pages_of_a_source", f"WITH {PAGES} SELECT id, source, count(*) OVER (PARTITION BY source) - 1 AS others FROM pages_")
def j9(spark, sf):
    """How many other pages share a page's source: counts are aggregated before they meet the pages."""
    p = pages(spark, sf).select("id", "source")
    counts = p.groupBy(F.col("source").alias("s")).agg((F.count("*") - 1).alias("others")).hint("rebalance")
    return p.join(counts, F.col("source") == F.col("s")).select("id", "source", "others")


@query("j16_vectors_to_pages", f"WITH {PAGES} SELECT id, label FROM pages_ JOIN embeddings ON n = vec_id")
def j16(spark, sf):
    return pages(spark, sf).join(table(spark, sf, "embeddings").select("vec_id", "label"), F.col("n") == F.col("vec_id")).select("id", "label")


@query("j18_page_sources", f"WITH {MANIFEST}, {PAGES} SELECT id, ref IS NULL AS missing FROM pages_ LEFT JOIN sources_ s ON ref = 'raw/articles/d' || (pages_.n + 3) || '.md'")
def j18(spark, sf):
    wanted = F.concat(F.lit("raw/articles/d"), (F.col("n") + 3).cast("string"), F.lit(".md"))
    return pages(spark, sf).join(sources(spark, sf).select("ref"), F.col("ref") == wanted, "left").select("id", F.col("ref").isNull().alias("missing"))


@query("j19_index_edges", f"WITH {EDGES} SELECT id FROM pages_ WHERE id NOT IN (SELECT dst FROM edges_ UNION SELECT id FROM pages_ WHERE n % 10 = 0)")
def j19(spark, sf):
    """Pages that nothing links to, an index file that names every tenth page included."""
    p, _, e = graph_of(spark, sf)
    ins = e.select(F.col("dst").alias("x")).union(p.where("n % 10 = 0").select("id")).distinct()
    return p.select("id").join(ins, F.col("id") == F.col("x"), "left_anti")


@query("j20_last_verdicts", f"WITH {VERDICTS}, v AS (SELECT page, arg_max(verdict, (ts, entry)) AS verdict FROM verdicts_ GROUP BY 1), {PAGES} SELECT id, coalesce(verdict, 'none') AS verdict FROM pages_ LEFT JOIN v ON page = 'page-' || n")
def j20(spark, sf):
    v = verdicts(spark, sf).groupBy("page").agg(F.max_by("verdict", F.struct("ts", "entry")).alias("verdict"))
    return pages(spark, sf).join(v, F.col("page") == F.concat(F.lit("page-"), F.col("n").cast("string")), "left").select("id", F.coalesce("verdict", F.lit("none")).alias("verdict"))


@query("w1_list_places", "SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS place FROM embeddings")
def w1(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", "label", (F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1).cast("long").alias("place"))


@query("w8_first_citations", f"WITH {LINKS} SELECT target, arg_min(src, (src, pos)) AS first FROM links_ GROUP BY 1")
def w8(spark, sf):
    return links(spark, sf).groupBy("target").agg(F.min_by("src", F.struct("src", "pos")).alias("first"))


@query("w10_most_linked", f"WITH {DEGREES} SELECT id, n_in FROM deg_ ORDER BY n_in DESC, id LIMIT 10")
def w10(spark, sf):
    p, _, e = graph_of(spark, sf)
    return graph.degrees(p, e).orderBy(F.desc("n_in"), "id").limit(10).select("id", "n_in")


@query("u2_deleted_keys", f"WITH {MANIFEST} SELECT key FROM manifest_ WHERE key NOT IN (SELECT ref FROM sources_)")
def u2(spark, sf):
    return manifest(spark, sf).select("key").join(sources(spark, sf).select(F.col("ref").alias("r")), F.col("key") == F.col("r"), "left_anti")


@query("u3_jaccard", "SELECT conv_id, turn, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6)::DOUBLE AS jaccard FROM (SELECT conv_id, turn, list_distinct(string_split(lower(text), ' ')) AS a, lag(list_distinct(string_split(lower(text), ' '))) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations) WHERE b IS NOT NULL")
def u3(spark, sf):
    words = F.array_distinct(F.split(F.lower("text"), " "))
    c = table(spark, sf, "conversations").select("conv_id", "turn", words.alias("a")).withColumn("b", F.lag("a").over(Window.partitionBy("conv_id").orderBy("turn"))).where("b IS NOT NULL")
    return c.select("conv_id", "turn", F.round(F.size(F.array_intersect("a", "b")) / F.size(F.array_union("a", "b")), 6).alias("jaccard"))


@query("u4_issue_union", f"WITH {LINKS} SELECT \"check\", count(*) AS n FROM (SELECT 'dead_link' AS \"check\" FROM links_ WHERE target NOT IN (SELECT id FROM pages_) UNION ALL SELECT 'stub' FROM pages_ WHERE length(trim(content)) < 100 AND NOT {AUTO}) GROUP BY 1")
def u4(spark, sf):
    p = pages(spark, sf)
    return lint.dead_links(links(spark, sf), p).unionByName(lint.stubs(p), allowMissingColumns=True).groupBy("check").agg(F.count("*").alias("n"))


@query("u5_group_union", f"WITH {EDGES} SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM edges_")
def u5(spark, sf):
    e = graph_of(spark, sf)[2]
    return e.select(F.array_sort(F.array("src", "dst")).alias("g")).distinct().select(F.col("g")[0].alias("a"), F.col("g")[1].alias("b"))


@query("g7_induced", f"WITH {EDGES} SELECT src, dst FROM edges_ WHERE src LIKE 'concepts/%' AND dst LIKE 'concepts/%'")
def g7(spark, sf):
    p, _, e = graph_of(spark, sf)
    return graph.induced(e, p.where("id LIKE 'concepts/%'"))


@query("r3_similar", "WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0) SELECT vec_id, similarity FROM (SELECT vec_id, round(1 / (1 + sqrt(list_sum(list_transform(list_zip(embedding, e), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) ** 2)))), 4) AS similarity FROM embeddings, q) WHERE similarity >= 0.3")
def r3(spark, sf):
    v = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    return retrieval.similar(v.withColumnRenamed("vec_id", "id"), v.where("vec_id = 0")).withColumnRenamed("id", "vec_id")


_NEAR = "(SELECT id, row_number() OVER (ORDER BY d, id) - 1 AS r FROM (SELECT id, vec_id, round(sqrt(list_sum(list_transform(list_zip(v.embedding, q.e), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) ** 2))), 6) AS d FROM (SELECT * FROM embeddings ORDER BY round(sqrt(list_sum(list_transform(list_zip(embedding, (SELECT embedding FROM embeddings WHERE vec_id = {0})), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) ** 2))), 15), vec_id LIMIT 20) v, (SELECT embedding AS e FROM embeddings WHERE vec_id = {0}) q JOIN pages_ ON n = vec_id))"


@query("r5_hybrid", f"WITH {PAGES}, {_bm25_sql(True)}, a_ AS (SELECT id, row_number() OVER (ORDER BY s DESC, id) - 1 AS r FROM (SELECT id, round(score, 6) AS s FROM score_ ORDER BY s DESC, id LIMIT 20)) SELECT id, round(sum(1 / (60 + r)), 9) AS score FROM (FROM a_ UNION ALL FROM {_NEAR.format(0)} UNION ALL FROM {_NEAR.format(1)}) GROUP BY 1 ORDER BY score DESC, id LIMIT 10")
def r5(spark, sf):
    """BM25 and nearest vectors of two variants of a question, fused."""
    p = pages(spark, sf)
    v = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    lists = [graph.ranked(retrieval.top(retrieval.bm25(p, QUESTION).withColumn("score", F.round("score", 6)), 20), [F.desc("score"), "id"]).select("id", "rank")]
    for k in (0, 1):
        near = retrieval.nearest(v, v.where(F.col("vec_id") == k), 20)
        hits = near.join(p.select("id", "n"), F.col("vec_id") == F.col("n"))
        lists.append(graph.ranked(hits, [F.round("distance", 6), "id"]).select("id", "rank"))
    return retrieval.top(retrieval.fused(lists).withColumn("score", F.round("score", 9)), 10)


@query("r11_raw_fallback", f"""WITH {PAGES}, {_bm25_sql(False)}, h_ AS (SELECT id, round(score, 6) AS s FROM score_ ORDER BY s DESC, id LIMIT 3), l_ AS (SELECT id, length(content) AS n, sum(length(content)) OVER (ORDER BY s DESC, id) AS upto, row_number() OVER (ORDER BY s DESC, id) AS k FROM h_ JOIN pages_ USING (id))
SELECT id, CAST(CASE WHEN upto <= 20000 THEN n ELSE 20000 END AS BIGINT) AS taken FROM l_ WHERE upto <= 20000 OR k = 1""")
def r11(spark, sf):
    p = pages(spark, sf)
    hits = retrieval.top(retrieval.bm25(p, QUESTION, title=False).withColumn("score", F.round("score", 6)), 3).join(p, "id")
    return retrieval.context(hits.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id"))).withColumn("type", F.lit("raw")), 20_000, stop=True)


@query("l2_fixed_links", f"""WITH {LINKS}, w AS (SELECT src, string_agg(CASE WHEN target IN (SELECT id FROM pages_) THEN 'see [[' || target || ']]' ELSE 'see ' || string_split(target, '/')[-1] END, ' ' ORDER BY pos) AS content, bool_or(target NOT IN (SELECT id FROM pages_)) AS dead FROM links_ GROUP BY 1) SELECT src AS id, content FROM w WHERE dead""")
def l2(spark, sf):
    p, l = pages(spark, sf), links(spark, sf)
    body = l.groupBy("src").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "target"))), lambda x: F.concat(F.lit("see [["), x["target"], F.lit("]]"))), " ").alias("content"))
    return edit.fix_dead_links(body.withColumnRenamed("src", "id"), lint.dead_links(l, p))


@query("x1_to_compile", f"WITH {DRIFT} SELECT state, count(*) AS n FROM drift_ WHERE state IS NOT NULL GROUP BY 1")
def x1(spark, sf):
    return records.drift(manifest(spark, sf), sources(spark, sf)).groupBy("state").agg(F.count("*").alias("n"))


_SAID = "regexp_matches(lower(content), '(^|[^\\p{L}\\p{N}_])' || lower(title) || '($|[^\\p{L}\\p{N}_])')"


@query("x5_mentions", f"""WITH {PAGES}, t AS (SELECT DISTINCT string_split(text, ' ')[2] AS title, 'entities/item-' || item_id AS target FROM benchmark WHERE regexp_full_match(string_split(text, ' ')[2], '[\\p{{L}}\\p{{N}}]+'))
SELECT p.id, arg_min(target, (-length(t.title), target)) AS target FROM pages_ p JOIN t ON p.id <> target AND {_SAID.replace('title', 't.title')} GROUP BY 1""")
def x5(spark, sf):
    """Which pages mention one of the benchmark's second words, taken as titles."""
    word = F.get(F.split("text", " "), F.lit(1))
    titles = table(spark, sf, "benchmark").select(word.alias("title"), F.concat(F.lit("entities/item-"), F.col("item_id").cast("string")).alias("target"))
    return edit.mentions(pages(spark, sf), titles.where(r"title rlike '^[\\p{L}\\p{N}]+$'"))


@query("e2_report", f"WITH {DEGREES}, {TRUST} SELECT (SELECT count(*) FROM pages_ WHERE length(trim(content)) < 100 AND NOT {AUTO}) AS stubs, (SELECT count(*) FROM deg_ WHERE n_in = 0) AS unlinked, (SELECT count(*) FROM trust_ WHERE round_even({_T}, 4) <= 0.4) AS flagged")
def e2(spark, sf):
    p, _, e = graph_of(spark, sf)
    n = lambda df, name: df.agg(F.count("*").alias(name))
    flagged = records.page_trust(feedback(spark, sf)).where(F.col("trust") <= records.LOW_TRUST)
    one = n(lint.stubs(p), "stubs").join(F.broadcast(n(graph.degrees(p, e).where("n_in = 0"), "unlinked")))  # one row each
    return one.join(F.broadcast(n(flagged, "flagged")))


@query("s4_two_phase", "SELECT user_id AS item, arg_max(CASE WHEN event_type IN ('error') THEN 'failed' WHEN event_type IN ('purchase') THEN 'applied' ELSE 'pending' END, (ts, event_id)) AS state FROM events GROUP BY 1")
def s4(spark, sf):
    state = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "applied").otherwise("pending")
    return records.latest_state(events(spark, sf).select(F.col("user_id").alias("item"), "ts", state.alias("state"), F.col("event_id").alias("nth")))


@query("snk14_output_names", f"WITH {PAGES} SELECT id, '2025-01-15-' || replace(id, '/', '-') || '.md' AS name FROM pages_")
def snk14(spark, sf):
    return pages(spark, sf).select("id", F.concat(F.lit(AS_OF + "-"), text.slug(F.replace(F.col("id"), F.lit("/"), F.lit(" "))), F.lit(".md")).alias("name"))


@query("snk7_unchanged", f"WITH {PAGES} SELECT type, max(updated) <= '2024-12-31' AS unchanged FROM pages_ WHERE NOT {HIDDEN} GROUP BY 1")
def snk7(spark, sf):
    return publish.kept(pages(spark, sf)).groupBy("type").agg((F.max("updated") <= "2024-12-31").alias("unchanged"))
