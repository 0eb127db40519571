"""Queries of joins, aggregates, windows, rules, drift and publishing."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import dates, text
from ..operators import graph, lint, publish, records
from .adapters import AS_OF, AUTHORED, DIRS, FEEDBACK, LINKS, MANIFEST, NOW, PAGES, VERDICTS, events, feedback, links, manifest, pages, pick, sources, table, verdicts
from .registry import query
from .scalars import STOP, TERMS15, tokens_sql

EDGES = f"""{LINKS}, edges_ AS (SELECT DISTINCT src, coalesce(p.id, b.id) AS dst FROM links_ l LEFT JOIN pages_ p ON l.target = p.id
  LEFT JOIN (SELECT string_split(id, '/')[2] AS slug, min(id) AS id FROM pages_ GROUP BY 1) b ON p.id IS NULL AND l.target = b.slug
  WHERE coalesce(p.id, b.id) IS NOT NULL AND coalesce(p.id, b.id) <> src)"""
HIDDEN = "(confidence = 'speculative' OR belief_state IN ('retracted', 'contradicted'))"
AUTO = "(id LIKE 'summaries/%' OR id LIKE 'comparisons/%' OR id LIKE 'synthesis/%')"


def graph_of(spark, sf):
    p, l = pages(spark, sf), links(spark, sf)
    return p, l, graph.edges(l, p)


@query("src12_page_keys", f"WITH {PAGES} SELECT id, lower('wiki/' || id) AS key FROM pages_")
def src12(spark, sf):
    path = F.concat(F.lit("WIKI\\"), F.replace(F.upper(F.col("id")), F.lit("/"), F.lit("\\")), F.lit(".MD"))
    return pages(spark, sf).select("id", F.regexp_replace(F.replace(F.lower(path), F.lit("\\"), F.lit("/")), r"\.md$", "").alias("key"))


@query("src11_source_types", f"WITH {MANIFEST} SELECT key, CASE WHEN key LIKE 'raw/articles/%' THEN 'article' ELSE 'paper' END AS kind FROM manifest_")
def src11(spark, sf):
    from ..sources.readers import source_type

    return manifest(spark, sf).select("key", source_type("key").alias("kind"))


@query("j1_links_to_pages", f"WITH {LINKS} SELECT src, pos, target, p.id IS NOT NULL AS found FROM links_ LEFT JOIN pages_ p ON target = p.id")
def j1(spark, sf):
    p = pages(spark, sf).select(F.col("id").alias("p"))
    return links(spark, sf).join(p, F.col("target") == F.col("p"), "left").select("src", "pos", "target", F.col("p").isNotNull().alias("found"))


@query("g1_edges", f"WITH {EDGES} SELECT src, dst FROM edges_")
def g1(spark, sf):
    return graph_of(spark, sf)[2]


@query("l1_dead_links", f"WITH {LINKS} SELECT 'dead_link' AS \"check\", 'error' AS severity, src AS page, target, '' AS message FROM links_ WHERE target NOT IN (SELECT id FROM pages_)")
def l1(spark, sf):
    return lint.dead_links(links(spark, sf), pages(spark, sf))


@query("j10_backlinks", f"WITH {LINKS} SELECT target AS page, string_agg(DISTINCT src, ',' ORDER BY src) AS sources FROM links_ WHERE target IN (SELECT id FROM pages_) GROUP BY 1")
def j10(spark, sf):
    p = pages(spark, sf).select(F.col("id").alias("p"))
    return links(spark, sf).join(p, F.col("target") == F.col("p"), "left_semi").groupBy(F.col("target").alias("page")).agg(F.array_join(F.array_sort(F.collect_set("src")), ",").alias("sources"))


@query("j4_source_coverage", f"WITH {MANIFEST}, {PAGES} SELECT ref FROM sources_ WHERE ref NOT IN (SELECT 'raw/articles/d' || n || '.md' FROM pages_ WHERE n % 4 = 0)")
def j4(spark, sf):
    cited = pages(spark, sf).where("n % 4 = 0").select(F.concat(F.lit("raw/articles/d"), F.col("n").cast("string"), F.lit(".md")).alias("ref"))
    return lint.source_coverage(sources(spark, sf).select("ref"), cited)


DRIFT = f"""{MANIFEST}, drift_ AS (SELECT coalesce(ref, key) AS ref, CASE WHEN key IS NULL THEN 'new' WHEN ref IS NULL THEN 'deleted' WHEN value <> hash THEN 'changed' END AS state FROM manifest_ FULL JOIN sources_ ON key = ref)"""


@query("j5_drift", f"WITH {DRIFT} SELECT * FROM drift_ WHERE state IS NOT NULL")
def j5(spark, sf):
    return records.drift(manifest(spark, sf), sources(spark, sf))


@query("x2_affected_pages", f"WITH {DRIFT}, {PAGES} SELECT id, ref AS refs FROM pages_ JOIN drift_ ON ref = 'raw/articles/d' || n || '.md' WHERE state <> 'new'")
def x2(spark, sf):
    p = pages(spark, sf).select("id", F.concat(F.lit("raw/articles/d"), F.col("n").cast("string"), F.lit(".md")).alias("ref"))
    return records.affected(records.drift(manifest(spark, sf), sources(spark, sf)).withColumnRenamed("ref", "x").select(F.col("x").alias("ref"), "state"), p)


@query("j7_template_changes", f"WITH {DRIFT} SELECT ref FROM sources_ WHERE kind = 'paper' AND ref NOT IN (SELECT ref FROM drift_ WHERE state IS NOT NULL)")
def j7(spark, sf):
    changed = spark.createDataFrame([("paper",)], "k string")
    found = records.drift(manifest(spark, sf), sources(spark, sf)).select(F.col("ref").alias("r"))
    return sources(spark, sf).join(F.broadcast(changed), F.col("kind") == F.col("k"), "left_semi").join(found, F.col("ref") == F.col("r"), "left_anti").select("ref")


@query("j8_duplicate_content", f"WITH {MANIFEST}, c AS (SELECT hash, min(ref) AS first, count(*) AS n FROM sources_ GROUP BY 1 HAVING count(*) > 1) SELECT ref, first, c.n AS copies FROM sources_ JOIN c USING (hash)")
def j8(spark, sf):
    s = sources(spark, sf).select("ref", "hash")
    many = s.groupBy(F.col("hash").alias("h")).agg(F.min("ref").alias("first"), F.count("*").alias("copies")).where("copies > 1").hint("rebalance")
    return s.join(many, F.col("hash") == F.col("h")).select("ref", "first", "copies")


@query("a9_shared_sources", f"WITH {PAGES} SELECT source, count(*) AS pages, min(id) AS first FROM pages_ GROUP BY 1 HAVING count(*) >= 2")
def a9(spark, sf):
    return pages(spark, sf).groupBy("source").agg(F.count("*").alias("pages"), F.min("id").alias("first")).where("pages >= 2")


@query("u1_affected_by_page", f"WITH {LINKS} SELECT src AS page FROM links_ WHERE target = 'entities/doc-0' UNION SELECT id FROM pages_ WHERE source = (SELECT source FROM pages_ WHERE n = 0) AND n <> 0")
def u1(spark, sf):
    """Pages that a change of one page touches: those that link to it and those that share its source."""
    p = pages(spark, sf)
    back = links(spark, sf).where("target = 'entities/doc-0'").select(F.col("src").alias("page"))
    own = p.where("n = 0").select(F.col("source").alias("s"))
    return back.union(p.where("n <> 0").join(F.broadcast(own), F.col("source") == F.col("s"), "left_semi").select("id")).distinct()


@query("a1_terms", f"WITH {PAGES}, w AS (SELECT id, unnest(list_concat(list_concat({tokens_sql('title')}, {tokens_sql('title')}), list_concat({tokens_sql('title')}, {tokens_sql('content')}))) AS term FROM pages_) SELECT term, count(DISTINCT id) AS df, count(*) AS cf FROM w GROUP BY 1")
def a1(spark, sf):
    """Document frequency of every term of the pages."""
    from ..operators.retrieval import postings

    return postings(pages(spark, sf)).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@query("a2_coverage", f"WITH {EDGES} SELECT d AS dir, count(n) AS pages, CAST(sum(CASE WHEN id LIKE 'concepts/%' AND id NOT IN (SELECT dst FROM edges_) THEN 1 ELSE 0 END) AS BIGINT) AS unlinked FROM (VALUES ('entities'), ('concepts'), ('comparisons'), ('summaries'), ('synthesis')) v(d) LEFT JOIN pages_ ON string_split(id, '/')[1] = d GROUP BY 1")
def a2(spark, sf):
    p, _, e = graph_of(spark, sf)
    linked = e.select(F.col("dst").alias("x")).distinct()
    flags = p.select("id", F.split("id", "/")[0].alias("d")).join(linked, F.col("id") == F.col("x"), "left")
    counts = flags.groupBy("d").agg(F.count("*").alias("pages"), F.sum(((F.col("d") == "concepts") & F.col("x").isNull()).cast("long")).alias("unlinked"))
    dims = spark.createDataFrame([(d,) for d in DIRS], "dir string")
    return dims.join(counts, F.col("dir") == F.col("d"), "left").select("dir", F.coalesce("pages", F.lit(0)).cast("long").alias("pages"), F.coalesce("unlinked", F.lit(0)).cast("long").alias("unlinked"))


@query("a4_verdict_summary", f"WITH {VERDICTS} SELECT verdict_type, count(*) FILTER (verdict = 'pass') AS passed, count(*) FILTER (verdict = 'fail') AS failed, count(*) FILTER (verdict = 'warning') AS warned, count(DISTINCT CASE WHEN verdict = 'fail' THEN page END) AS failing_pages FROM verdicts_ GROUP BY 1")
def a4(spark, sf):
    n = lambda v: F.sum((F.col("verdict") == v).cast("long"))
    return verdicts(spark, sf).groupBy("verdict_type").agg(n("pass").alias("passed"), n("fail").alias("failed"), n("warning").alias("warned"), F.countDistinct(F.when(F.col("verdict") == "fail", F.col("page"))).alias("failing_pages"))


@query("a5_verdict_weeks", f"WITH {VERDICTS} SELECT strftime(date_trunc('week', ts), '%Y-%m-%d') AS week, count(*) FILTER (verdict = 'pass') AS passed, count(*) FILTER (verdict = 'fail') AS failed, count(*) FILTER (verdict = 'warning') AS warned, count(*) AS total, round(count(*) FILTER (verdict = 'pass') / count(*), 2) AS rate FROM verdicts_ GROUP BY 1")
def a5(spark, sf):
    w = records.weekly(verdicts(spark, sf))
    return w.withColumn("week", F.date_format("week", "yyyy-MM-dd"))


@query("w5_verdict_trend", f"WITH {VERDICTS}, w AS (SELECT date_trunc('week', ts) AS week, count(*) AS total, round(count(*) FILTER (verdict = 'pass') / count(*), 2) AS rate FROM verdicts_ GROUP BY 1), l AS (SELECT rate, lag(rate) OVER (ORDER BY week) AS prev, least(total, lag(total) OVER (ORDER BY week)) AS least_, row_number() OVER (ORDER BY week DESC) AS k FROM w) SELECT CASE WHEN least_ < 3 THEN 'stable' WHEN round(rate - prev, 4) > 0.1 THEN 'improving' WHEN round(rate - prev, 4) < -0.1 THEN 'declining' ELSE 'stable' END AS trend, round(rate - prev, 4) AS change FROM l WHERE k = 1")
def w5(spark, sf):
    return records.trend(records.weekly(verdicts(spark, sf)))


TRUST = f"""{FEEDBACK}, trust_ AS (SELECT page, count(*) FILTER (rating = 'useful') AS useful, count(*) FILTER (rating = 'wrong') AS wrong, count(*) FILTER (rating = 'incomplete') AS incomplete FROM feedback_ GROUP BY 1)"""
_T = "(useful + 1) / (useful + 2 * wrong + incomplete + 2)"


@query("a6_trust", f"WITH {TRUST} SELECT page, useful, wrong, incomplete, round_even({_T}, 4) AS trust FROM trust_")
def a6(spark, sf):
    return records.page_trust(feedback(spark, sf)).drop("last")


@query("a7_flagged", f"WITH {TRUST} SELECT page FROM trust_ WHERE round_even({_T}, 4) <= 0.4")
def a7(spark, sf):
    return records.page_trust(feedback(spark, sf)).where(F.col("trust") <= records.LOW_TRUST).select("page")


@query("j17_trust_on_pages", f"WITH {TRUST}, {PAGES} SELECT id, coalesce(round_even({_T}, 4), 0.5)::DOUBLE AS trust FROM pages_ LEFT JOIN trust_ ON page = 'page-' || n")
def j17(spark, sf):
    t = records.page_trust(feedback(spark, sf)).select("page", "trust")
    return pages(spark, sf).join(t, F.col("page") == F.concat(F.lit("page-"), F.col("n").cast("string")), "left").select("id", F.coalesce("trust", F.lit(0.5)).alias("trust"))


@query("a11_new_pages", f"WITH {LINKS} SELECT target, count(*) AS n, string_agg(src, ',' ORDER BY src) AS referenced_by FROM links_ WHERE target NOT IN (SELECT id FROM pages_) GROUP BY 1")
def a11(spark, sf):
    return lint.dead_links(links(spark, sf), pages(spark, sf)).groupBy("target").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("page")), ",").alias("referenced_by"))


@query("a12_outcomes", "SELECT count(*) FILTER (state = 'done') AS done, count(*) FILTER (state = 'failed') AS failed, count(*) FILTER (state = 'running') AS running FROM (SELECT arg_max(CASE event_type WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' ELSE 'running' END, (ts, event_id)) AS state FROM events GROUP BY user_id)")
def a12(spark, sf):
    s = records.latest_state(state_log(spark, sf))
    n = lambda v: F.sum((F.col("state") == v).cast("long")).alias(v)
    return s.agg(n("done"), n("failed"), n("running"))


def state_log(spark, sf):
    state = F.when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "error", "failed").otherwise("running")
    return events(spark, sf).select(F.col("user_id").alias("item"), "ts", state.alias("state"), F.col("event_id").alias("nth"))


@query("s5_latest_state", "SELECT user_id AS item, arg_max(CASE event_type WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' ELSE 'running' END, (ts, event_id)) AS state FROM events GROUP BY 1")
def s5(spark, sf):
    return records.latest_state(state_log(spark, sf))


@query("a14_newest_source", f"WITH {PAGES} SELECT source, max(updated) AS newest FROM pages_ GROUP BY 1")
def a14(spark, sf):
    return pages(spark, sf).groupBy("source").agg(F.max("updated").alias("newest"))


@query("a15_source_listing", "SELECT source, count(*) AS files, round(sum(strlen(text)) / 1024, 1) AS kb FROM documents GROUP BY 1")
def a15(spark, sf):
    return table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("files"), F.round(F.sum(F.octet_length("text")) / 1024, 1).alias("kb"))


@query("w4_gaps", f"WITH {FEEDBACK} SELECT question, entry, page FROM (SELECT *, row_number() OVER (PARTITION BY question ORDER BY length(notes) DESC, ts DESC, entry) AS r FROM feedback_ WHERE rating = 'incomplete' AND question <> '') WHERE r = 1")
def w4(spark, sf):
    return records.gaps(feedback(spark, sf))


@query("w7_newest_log", f"WITH {VERDICTS} SELECT entry, page FROM verdicts_ ORDER BY ts DESC, entry DESC LIMIT 10000")
def w7(spark, sf):
    return records.newest(verdicts(spark, sf), "ts", 10_000, "entry").select("entry", "page")


@query("w9_enrichment", f"WITH {PAGES} SELECT id, CASE status WHEN 'seed' THEN 0 ELSE 1 END AS priority FROM pages_ WHERE status NOT IN ('mature', 'evergreen') ORDER BY 2, 1")
def w9(spark, sf):
    return pages(spark, sf).where(~F.col("status").isin("mature", "evergreen")).select("id", F.when(F.col("status") == "seed", 0).otherwise(1).alias("priority")).orderBy("priority", "id")


@query("w11_page_list", f"WITH {PAGES} SELECT id, title FROM pages_ WHERE type = 'concept' ORDER BY id LIMIT 50 OFFSET 20")
def w11(spark, sf):
    """A page of a listing: the limit and offset are the feature."""
    return pages(spark, sf).where("type = 'concept'").orderBy("id").offset(20).limit(50).select("id", "title")


@query("w12_page_history", f"WITH {VERDICTS} SELECT page, entry, row_number() OVER (PARTITION BY page ORDER BY ts DESC, entry DESC) AS nth FROM verdicts_")
def w12(spark, sf):
    return verdicts(spark, sf).select("page", "entry", F.row_number().over(Window.partitionBy("page").orderBy(F.desc("ts"), F.desc("entry"))).cast("long").alias("nth"))


@query("w13_chunks", f"WITH {PAGES}, g AS (SELECT updated, id, (row_number() OVER (PARTITION BY updated ORDER BY id) - 1) // 5 AS chunk FROM pages_) SELECT updated, id, chunk FROM (SELECT *, count(*) OVER (PARTITION BY updated, chunk) AS m FROM g) WHERE m > 1")
def w13(spark, sf):
    return lint.chunked(pages(spark, sf).select("updated", "id"), "updated", "id")


@query("w14_title_order", f"WITH {PAGES} SELECT id, length(title) AS n FROM pages_ ORDER BY n DESC, id LIMIT 200")
def w14(spark, sf):
    return pages(spark, sf).select("id", F.char_length("title").cast("long").alias("n")).orderBy(F.desc("n"), "id").limit(200)


@query("l3_orphans", f"WITH {EDGES} SELECT 'orphan' AS \"check\", 'warning' AS severity, id AS page, '' AS target, CASE WHEN id IN (SELECT src FROM edges_) THEN 'no inbound' ELSE 'isolated' END AS message FROM pages_ WHERE NOT {AUTO} AND id NOT IN (SELECT dst FROM edges_)")
def l3(spark, sf):
    p, _, e = graph_of(spark, sf)
    return lint.orphans(p, e)


@query("l4_stubs", f"WITH {PAGES} SELECT 'stub' AS \"check\", 'info' AS severity, id AS page, '' AS target, '' AS message FROM pages_ WHERE length(trim(content)) < 100 AND NOT {AUTO}")
def l4(spark, sf):
    return lint.stubs(pages(spark, sf))


@query("l6_newer_than_updated", f"WITH {PAGES} SELECT id FROM pages_ WHERE n % 3 = 2")
def l6(spark, sf):
    """Pages whose file, a day older to a day younger than their date, is younger."""
    dated = pages(spark, sf).withColumn("file_day", F.date_add(F.try_to_date("updated"), (F.col("n") % 3 - 1).cast("int")))
    return lint.file_stale(dated).select(F.col("page").alias("id"))


@query("l7_mature_stale", f"WITH {PAGES} SELECT 'status_mature_stale' AS \"check\", 'warning' AS severity, id AS page, '' AS target, '' AS message FROM pages_ WHERE status = 'mature' AND CAST(updated AS DATE) < DATE '{AS_OF}' - 90")
def l7(spark, sf):
    return lint.mature_stale(pages(spark, sf), AS_OF)


@query("l8_authored_drift", f"WITH {PAGES} SELECT 'authored_by_drift' AS \"check\", 'warning' AS severity, id AS page, '' AS target, '' AS message FROM pages_ WHERE authored_by = 'human' AND n % 5 = 0")
def l8(spark, sf):
    p = pages(spark, sf).withColumn("content", F.when(F.col("n") % 5 == 0, F.concat("content", F.lit("\n## Evidence Trail\n- x | action: ingest\n## More"))).otherwise(F.concat("content", F.lit("\n## Evidence Trail\n- x\n## More\naction: ingest"))))
    return lint.authored_drift(p)


@query("l12_alike_slugs", f"WITH {PAGES}, s AS (SELECT DISTINCT regexp_replace(lower(replace(title, '_', '-')), '[^a-z. -]', 'x', 'g') AS id FROM pages_ WHERE length(title) > 0) SELECT a.id, b.id AS id2, CAST(levenshtein(a.id, b.id) AS INT) AS distance FROM s a JOIN s b ON a.id < b.id AND abs(length(a.id) - length(b.id)) <= 3 WHERE levenshtein(a.id, b.id) BETWEEN 1 AND 3")
def l12(spark, sf):
    """Whole titles as slugs; letters beyond ASCII become x, as the distance is one of bytes in the other engine."""
    ids = pages(spark, sf).where("title <> ''").select(F.regexp_replace(F.lower(F.replace(F.col("title"), F.lit("_"), F.lit("-"))), "[^a-z. -]", "x").alias("id")).distinct()
    return lint.alike_slugs(ids)


@query("l14_severities", f"WITH {LINKS} SELECT severity, count(*) AS n FROM (SELECT 'error' AS severity FROM links_ WHERE target NOT IN (SELECT id FROM pages_) UNION ALL SELECT 'info' FROM pages_ WHERE length(trim(content)) < 100 AND NOT {AUTO} UNION ALL SELECT 'warning' FROM pages_ WHERE status = 'mature' AND CAST(updated AS DATE) < DATE '{AS_OF}' - 90) GROUP BY 1")
def l14(spark, sf):
    p = pages(spark, sf)
    return lint.rollup(lint.dead_links(links(spark, sf), p).unionByName(lint.stubs(p)).unionByName(lint.mature_stale(p, AS_OF)))


@query("p6_admission", f"WITH {EDGES} SELECT id FROM pages_ WHERE length(trim(content)) < 500 AND NOT {AUTO} AND confidence <> 'speculative' AND title <> '' AND id IN (SELECT dst FROM edges_ WHERE src NOT LIKE 'summaries/%' AND src NOT LIKE 'comparisons/%' AND src NOT LIKE 'synthesis/%')")
def p6(spark, sf):
    p, _, e = graph_of(spark, sf)
    inbound = e.where(~lint.autogen(F.col("src"))).select(F.col("dst").alias("x"))
    return p.where((F.char_length(F.trim("content")) < 500) & ~lint.autogen(F.col("id")) & (F.col("confidence") != "speculative") & (F.col("title") != "")).join(inbound, F.col("id") == F.col("x"), "left_semi").select("id")


@query("snk1_index", f"WITH {PAGES} SELECT type, id, '- ' || title || ' — ' || source || ' — ' || updated AS line FROM pages_ WHERE NOT {HIDDEN}")
def snk1(spark, sf):
    return publish.index_lines(pages(spark, sf))


@query("snk1_index_text", f"WITH {PAGES}, k AS (SELECT * FROM pages_ WHERE NOT {HIDDEN}), a AS (SELECT type, 1 AS part, id, '- ' || title || ' — ' || source || ' — ' || updated AS line FROM k UNION ALL SELECT DISTINCT type, 0, '', '## ' || type FROM k UNION ALL SELECT chr(1114111), 2, '', '[!excluded] ' || count(*) || ' pages' FROM pages_ WHERE {HIDDEN} HAVING count(*) > 0) SELECT row_number() OVER (ORDER BY type, part, id) - 1 AS place, line FROM a")
def snk1_text(spark, sf):
    return publish.index_text(pages(spark, sf))


@query("snk2_full_text", f"WITH {PAGES}, s AS (SELECT id, strlen(content) AS n, sum(strlen(content)) OVER (ORDER BY id) - strlen(content) AS start FROM pages_ WHERE NOT {HIDDEN}) SELECT id, CAST(least(n, 5242880 - start) AS BIGINT) AS bytes FROM s WHERE start < 5242880")
def snk2(spark, sf):
    return publish.within_budget(pages(spark, sf))


@query("snk3_jsonld", f"WITH {LINKS}, k AS (SELECT * FROM pages_ WHERE NOT {HIDDEN}) SELECT k.id, '{{\"@type\":\"WebPage\",\"@id\":\"' || k.id || '\",\"citation\":[' || coalesce(c.l, '') || ']}}' AS node FROM k LEFT JOIN (SELECT src, string_agg('\"' || target || '\"', ',' ORDER BY pos) AS l FROM links_ WHERE target IN (SELECT id FROM k) GROUP BY 1) c ON src = k.id")
def snk3(spark, sf):
    return publish.jsonld(pages(spark, sf), links(spark, sf))


@query("snk4_siblings", f"WITH {PAGES} SELECT id, sha256('# ' || title || chr(10) || chr(10) || content) AS txt FROM pages_ WHERE NOT {HIDDEN}")
def snk4(spark, sf):
    return publish.siblings(pages(spark, sf)).select("id", F.sha2("txt", 256).alias("txt"))


@query("snk5_sitemap", f"WITH {PAGES} SELECT id, '<url><loc>pages/' || id || '.txt</loc><lastmod>' || updated || '</lastmod></url>' AS entry FROM pages_ WHERE NOT {HIDDEN}")
def snk5(spark, sf):
    return publish.sitemap(pages(spark, sf))


@query("snk6_excluded", f"WITH {PAGES} SELECT {HIDDEN} AS hidden, count(*) AS n FROM pages_ GROUP BY 1")
def snk6(spark, sf):
    return pages(spark, sf).groupBy(publish.hidden().alias("hidden")).agg(F.count("*").alias("n"))


DEGREES = f"{EDGES}, deg_ AS (SELECT id, (SELECT count(*) FROM edges_ WHERE dst = id) AS n_in, (SELECT count(*) FROM edges_ WHERE src = id) AS n_out FROM pages_)"


@query("g6_degrees", f"WITH {DEGREES} SELECT id, n_in, n_out FROM deg_")
def g6(spark, sf):
    p, _, e = graph_of(spark, sf)
    return graph.degrees(p, e)


@query("snk12_mermaid", f"WITH {DEGREES}, t AS (SELECT id FROM deg_ ORDER BY n_in + n_out DESC, id LIMIT 30), l AS (SELECT '    ' || translate(src, '/-', '__') || ' --> ' || translate(dst, '/-', '__') AS line FROM edges_ WHERE src IN (FROM t) AND dst IN (FROM t)) SELECT 'graph LR' || chr(10) || coalesce(string_agg(line, chr(10) ORDER BY line), '') AS graph FROM l")
def snk12(spark, sf):
    p, _, e = graph_of(spark, sf)
    return graph.mermaid(e, graph.degrees(p, e))


@query("a3_graph_stats", f"WITH RECURSIVE {DEGREES}, both_ AS (SELECT src AS a, dst AS b FROM edges_ UNION SELECT dst, src FROM edges_), r(id, x) AS (SELECT id, id FROM pages_ UNION SELECT r.id, both_.b FROM r JOIN both_ ON r.x = both_.a), c AS (SELECT id, min(x) AS component FROM r GROUP BY 1), t AS (SELECT id, n_in FROM deg_ ORDER BY n_in DESC, id LIMIT 10) SELECT count(*) AS nodes, (SELECT count(*) FROM edges_) AS edges, count(*) FILTER (n_in = 0 AND n_out > 0) AS no_inbound, count(*) FILTER (n_in = 0 AND n_out = 0) AS isolated, (SELECT count(*) FROM c WHERE id = component) AS components, (SELECT string_agg(id, ' ' ORDER BY n_in DESC, id) FROM t) AS most_linked FROM deg_")
def a3(spark, sf):
    p, _, e = graph_of(spark, sf)
    return graph.stats(p.select("id"), e).withColumn("most_linked", F.array_join("most_linked", " "))


def _pagerank_sql(rounds: int) -> str:
    """Power iteration written out, round after round."""
    steps = ["n_ AS (SELECT count(*)::DOUBLE AS total FROM pages_)", "out_ AS (SELECT src, count(*)::DOUBLE AS k FROM edges_ GROUP BY 1)", "r0 AS MATERIALIZED (SELECT id, 1 / total AS rank FROM pages_, n_)"]
    for i in range(1, rounds + 1):
        lost = f"(SELECT coalesce(sum(rank), 0) FROM r{i - 1} WHERE id NOT IN (SELECT src FROM out_))"
        got = f"(SELECT dst, sum(rank / k) AS got FROM edges_ JOIN out_ USING (src) JOIN r{i - 1} ON id = src GROUP BY 1)"
        steps.append(f"r{i} AS MATERIALIZED (SELECT id, 0.15 / total + 0.85 * (coalesce(got, 0) + {lost} / total) AS rank FROM pages_ LEFT JOIN {got} ON dst = id, n_)")
    return ", ".join(steps)


@query("g2_pagerank", f"WITH {EDGES}, {_pagerank_sql(20)} SELECT id, round(rank, 9) AS rank FROM r20")
def g2(spark, sf):
    p, _, e = graph_of(spark, sf)
    return graph.pagerank(p, e, rounds=20, tol=0.0).select("id", F.round("rank", 9).alias("rank"))


@query("g3_components", f"WITH RECURSIVE {EDGES}, both_ AS (SELECT src AS a, dst AS b FROM edges_ UNION SELECT dst, src FROM edges_), r(id, x) AS (SELECT id, id FROM pages_ UNION SELECT r.id, both_.b FROM r JOIN both_ ON r.x = both_.a) SELECT id, min(x) AS component FROM r GROUP BY 1")
def g3(spark, sf):
    p, _, e = graph_of(spark, sf)
    return graph.weak_components(p, e)


@query("g5_cycles", f"""WITH RECURSIVE {EDGES}, k_ AS MATERIALIZED (FROM edges_), w_(head, tail, path) AS (SELECT src, dst, [src, dst] FROM k_ WHERE src < dst UNION ALL SELECT head, dst, list_append(path, dst) FROM w_ JOIN k_ ON src = tail WHERE dst > head AND NOT list_contains(path, dst) AND len(path) < 24),
c_ AS (SELECT CAST(len(path) AS BIGINT) AS length, array_to_string(path, ' > ') AS path FROM w_ JOIN k_ ON src = tail AND dst = head ORDER BY 1, 2 LIMIT 100)
SELECT * FROM c_ UNION ALL SELECT 0, '__truncated__' WHERE (SELECT count(*) FROM c_) = 100""")
def g5(spark, sf):
    """The first hundred cycles of any length."""
    return graph.cycles(graph_of(spark, sf)[2])


@query("g4_bridges", f"""WITH RECURSIVE {EDGES}, k_ AS MATERIALIZED (FROM edges_), root_ AS MATERIALIZED (SELECT id AS root FROM pages_ ORDER BY md5('0:' || id), id LIMIT {graph.PIVOTS}),
far_(root, v, d) USING KEY (root, v) AS (SELECT root, root, 0 FROM root_ UNION SELECT f.root, dst, min(d) + 1 FROM far_ f JOIN k_ ON src = v WHERE NOT EXISTS (SELECT 1 FROM recurring.far_ r WHERE r.root = f.root AND r.v = dst) GROUP BY 1, 2),
at_ AS MATERIALIZED (FROM far_), way_ AS MATERIALIZED (SELECT a.root, a.v AS a, b.v AS b, a.d AS d FROM at_ a JOIN k_ ON src = a.v JOIN at_ b ON b.root = a.root AND b.v = dst AND b.d = a.d + 1),
paths_(root, v, n) AS (SELECT root, root, 1::DOUBLE FROM root_ UNION ALL SELECT w.root, w.b, sum(n) FROM paths_ p JOIN way_ w ON w.root = p.root AND w.a = p.v GROUP BY 1, 2), n_ AS MATERIALIZED (FROM paths_),
share_(k, root, v, part) AS (SELECT d, root, v, 0::DOUBLE FROM at_ WHERE d = (SELECT max(d) FROM at_) UNION ALL
  SELECT t.d, t.root, t.v, coalesce(sum(x.part), 0) FROM (SELECT min(k) - 1 AS k FROM share_) l JOIN at_ t ON t.d = l.k LEFT JOIN (SELECT w.root, w.a, up.n / low.n * (1 + s.part) AS part FROM share_ s JOIN way_ w ON w.root = s.root AND w.b = s.v JOIN n_ up ON up.root = w.root AND up.v = w.a JOIN n_ low ON low.root = w.root AND low.v = w.b) x ON x.root = t.root AND x.a = t.v GROUP BY 1, 2, 3),
sum_ AS (SELECT v, sum(part) AS part FROM share_ WHERE root <> v GROUP BY 1), one_ AS (SELECT count(*)::DOUBLE AS total FROM pages_)
SELECT id, round(coalesce(part, 0) / ((total - 1) * (total - 2)) * greatest(total / {graph.PIVOTS}, 1), 8) AS score FROM pages_ CROSS JOIN one_ LEFT JOIN sum_ ON v = id""")
def g4(spark, sf):
    """How much every page lies between others, from all pages or from as many as PIVOTS."""
    p, _, e = graph_of(spark, sf)
    return graph.betweenness(p, e, batch=graph.PIVOTS).select("id", F.round("score", 8).alias("score"))


TERMS_MIN = 3


@query("e1_connections", f"""WITH {EDGES}, t AS (SELECT id, unnest({TERMS15.format('content')}) AS term FROM pages_), d AS (SELECT term FROM t GROUP BY 1 HAVING count(*) BETWEEN 2 AND 5),
p AS (SELECT x.id AS a, y.id AS b, count(*) AS shared FROM t x JOIN t y ON x.term = y.term AND x.id < y.id WHERE x.term IN (FROM d) GROUP BY 1, 2 HAVING count(*) >= 3)
SELECT a, b, shared FROM p WHERE NOT EXISTS (SELECT 1 FROM edges_ WHERE least(src, dst) = a AND greatest(src, dst) = b)""")
def e1(spark, sf):
    return records.connections(pages(spark, sf), graph_of(spark, sf)[2])


def _sentences_sql(c: str) -> str:
    return f"string_split(regexp_replace({c}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))"


_SIGNIFICANT = f"""list_distinct(list_filter(list_concat(list_filter(list_transform(regexp_extract_all(s, '\\.NET|[A-Z][+#a-z]*'), lambda x: lower(x)), lambda x: regexp_matches(x, '[+#.]') OR x IN ('c', 'r', 'go', 'f', 'd')),
  list_filter(regexp_extract_all(lower(s), '{text.TOKEN}'), lambda x: length(x) > 2)), lambda x: x NOT IN ({STOP})))"""
_NEGATED = "regexp_matches(s, '(?i)(^|[^\\p{L}\\p{N}_])(not|never|no longer|instead|rather than|unlike|contrary|wrong|incorrect|false|replaced|deprecated|obsolete|outdated)([^\\p{L}\\p{N}_]|$)')"


@query("x12_contradictions", f"""WITH {PAGES}, c0 AS (SELECT item_id AS claim, unnest({_sentences_sql('text')}) AS s, generate_subscripts({_sentences_sql('text')}, 1) - 1 AS part FROM benchmark),
c AS (SELECT claim, part, trim(s) AS s FROM c0 WHERE trim(s) <> ''), ct AS (SELECT claim, part, {_NEGATED} AS no, {_SIGNIFICANT} AS terms FROM c),
b AS (SELECT id, CASE WHEN n % 3 = 0 THEN replace(content, '.', ' not.') ELSE content END AS content FROM pages_),
p0 AS (SELECT id, unnest({_sentences_sql('content')}) AS s, generate_subscripts({_sentences_sql('content')}, 1) - 1 AS nth FROM b), p AS (SELECT id, nth, trim(s) AS s FROM p0 WHERE trim(s) <> ''),
x AS (SELECT claim, part, no, unnest(terms) AS t FROM ct WHERE len(terms) >= 2), y AS (SELECT id, nth, {_NEGATED} AS has, unnest({_SIGNIFICANT}) AS t FROM p),
m AS (SELECT claim, part, id, nth, no, has FROM x JOIN y USING (t) GROUP BY ALL HAVING count(*) >= 2), k AS (SELECT *, row_number() OVER (PARTITION BY claim, part, id ORDER BY nth) AS r FROM m)
SELECT claim, CAST(part AS INT) AS part, id, CAST(min(nth) AS INT) AS nth FROM k WHERE r <= 5 AND no <> has GROUP BY 1, 2, 3""")
def x12(spark, sf):
    """Claims are the benchmark's passages, whole; in a third of the pages every sentence is negated."""
    claims = table(spark, sf, "benchmark").select(F.col("item_id").alias("claim"), "text")
    p = pages(spark, sf).withColumn("content", F.when(F.col("n") % 3 == 0, F.replace(F.col("content"), F.lit("."), F.lit(" not."))).otherwise(F.col("content")))
    return records.contradictions(claims, p)


@query("s1_rate_limit", """WITH RECURSIVE c AS (SELECT user_id AS key, event_id AS entry, epoch_us(ts) // 1000000 AS sec, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000000, event_id) AS k FROM events),
f(key, k, entry, accepted, live) AS (SELECT key, k, entry, true, [sec] FROM c WHERE k = 1 UNION ALL
  SELECT c.key, c.k, c.entry, len(list_filter(live, lambda t: t >= sec - 3600)) < 2, CASE WHEN len(list_filter(live, lambda t: t >= sec - 3600)) < 2 THEN list_append(list_filter(live, lambda t: t >= sec - 3600), sec) ELSE live END FROM f JOIN c ON c.key = f.key AND c.k = f.k + 1)
SELECT entry, accepted FROM f""")
def s1(spark, sf):
    calls = events(spark, sf).select(F.col("user_id").alias("key"), F.col("event_id").alias("entry"), F.col("ts").cast("long").alias("at"))
    return records.limited(calls, 2)


@query("s3_stale_pending", f"SELECT event_id AS entry FROM events WHERE event_type = 'click' AND ts < TIMESTAMP '{NOW}' - INTERVAL 168 HOUR")
def s3(spark, sf):
    old = F.lit(NOW).cast("timestamp") - F.expr("INTERVAL 168 HOUR")
    return events(spark, sf).where((F.col("event_type") == "click") & (F.col("ts") < old)).select(F.col("event_id").alias("entry"))


@query("s6_cooldown", f"SELECT user_id AS item, max(ts) >= TIMESTAMP '{NOW}' - INTERVAL 24 HOUR AS cooling FROM events GROUP BY 1")
def s6(spark, sf):
    since = F.lit(NOW).cast("timestamp") - F.expr("INTERVAL 24 HOUR")
    return events(spark, sf).groupBy(F.col("user_id").alias("item")).agg((F.max("ts") >= since).alias("cooling"))


@query("s8_tumbling_weeks", f"WITH {VERDICTS} SELECT strftime(date_trunc('week', ts), '%Y-%m-%d') AS week, count(*) AS n FROM verdicts_ GROUP BY 1")
def s8(spark, sf):
    w = F.window("ts", "1 week", startTime="4 days")
    return verdicts(spark, sf).groupBy(w.alias("w")).agg(F.count("*").alias("n")).select(F.date_format("w.start", "yyyy-MM-dd").alias("week"), "n")
