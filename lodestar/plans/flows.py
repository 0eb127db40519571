"""Queries of taking in, capture, augmenting, consistency and answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import answering, augment, capture, consistency, graph, ingest, lint, models, records
from .adapters import AS_OF, LINKS, MANIFEST, PAGES, VERDICTS, events, links, manifest, pages, sources, table, verdicts
from .registry import query
from .relations import AUTO, EDGES, graph_of
from .searches import QUESTION


def extractions(spark, sf):
    """One extraction for each conversation: its turns are the claims, the second words of its turns entities."""
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("t"))
    turns = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "t"))).alias("x"))
    said = F.transform("x", lambda x: x["t"])
    words = F.filter(F.transform(said, lambda t: F.get(F.split(t, " "), F.lit(1))), lambda w: w.isNotNull() & w.rlike(r"^[a-zA-Z]+$"))
    idea = F.concat(F.lit("Idea "), (F.col("conv_id") % 3).cast("string"))
    null, none = F.lit(None).cast("string"), F.lit(None).cast("array<string>")
    return turns.select(
        F.concat(F.lit("raw/conversations/c"), F.col("conv_id").cast("string"), F.lit(".md")).alias("ref"), F.concat(F.lit("Talk "), F.col("conv_id").cast("string")).alias("title"), null.alias("name"), null.alias("author"), null.alias("speaker"),
        F.array(F.lit("Ann"), F.lit("Bo")).alias("authors"), null.alias("core_argument"), null.alias("abstract"), F.when(F.col("conv_id") % 2 == 0, F.get(said, F.lit(0))).alias("description"), null.alias("problem_solved"),
        said.alias("key_claims"), none.alias("key_points"), none.alias("key_arguments"), words.alias("entities_mentioned"), F.array(idea, F.lit("???"), F.get(words, F.lit(0))).alias("concepts_mentioned"),
    )


#: The same in SQL. Supplied texts have no comments, rules or second headings for field() to take out.
EXTRACTIONS = """c_ AS (SELECT conv_id, list(coalesce(text, '') ORDER BY turn) AS said FROM conversations GROUP BY 1),
e_ AS (SELECT conv_id, 'raw/conversations/c' || conv_id || '.md' AS ref, 'Talk ' || conv_id AS title, said, CASE WHEN conv_id % 2 = 0 AND trim(said[1]) <> '' THEN said[1] END AS description,
  list_filter(list_transform(said, lambda t: string_split(t, ' ')[2]), lambda w: regexp_full_match(w, '[a-zA-Z]+')) AS words, 'Idea ' || (conv_id % 3) AS idea FROM c_)"""
_FIELD = "CASE WHEN length({0}) > 2000 THEN left({0}, 2000) || '... [truncated]' ELSE {0} END"


@query("x9_summaries", f"""WITH {EXTRACTIONS} SELECT ref, sha256('# ' || title || chr(10) || chr(10) || '**Authors:** Ann, Bo' || chr(10)
  || CASE WHEN description IS NULL THEN '' ELSE chr(10) || chr(10) || '## Overview' || chr(10) || chr(10) || {_FIELD.format('description')} || chr(10) END
  || chr(10) || chr(10) || '## Key Claims' || chr(10) || chr(10) || array_to_string(list_transform(said, lambda t: '- ' || {_FIELD.format('t')}), chr(10)) || chr(10)
  || CASE WHEN len(words) = 0 THEN '' ELSE chr(10) || chr(10) || '## Entities Mentioned' || chr(10) || chr(10) || array_to_string(list_transform(words, lambda w: '- [[entities/' || lower(w) || '|' || w || ']]'), chr(10)) || chr(10) END
  || chr(10) || chr(10) || '## Concepts' || chr(10) || chr(10) || '- [[concepts/' || replace(lower(idea), ' ', '-') || '|' || idea || ']]' || CASE WHEN len(words) = 0 THEN '' ELSE chr(10) || '- [[concepts/' || lower(words[1]) || '|' || words[1] || ']]' END || chr(10)) AS digest FROM e_""")
def x9_summaries(spark, sf):
    return extractions(spark, sf).select("ref", F.sha2(ingest.summary(), 256).alias("digest"))


@query("x8_items", f"""WITH {EXTRACTIONS}, i AS (SELECT ref, 0 AS o, generate_subscripts(words, 1) AS nth, unnest(words) AS name FROM e_ UNION ALL SELECT ref, 1, 0, idea FROM e_ UNION ALL SELECT ref, 1, 2, words[1] FROM e_ WHERE len(words) > 0),
s AS (SELECT *, replace(lower(name), ' ', '-') AS slug FROM i WHERE o = 1 OR nth <= 50) SELECT ref, slug, arg_min(name, (o, nth)) AS name, CASE min(o) WHEN 0 THEN 'entities' ELSE 'concepts' END AS kind FROM s GROUP BY 1, 2""")
def x8_items(spark, sf):
    """Items of each source: the first of a slug stays, entities before concepts."""
    return ingest.items(extractions(spark, sf)).select("ref", "slug", "name", "kind")


@query("x9_item_pages", f"""WITH {EXTRACTIONS}, i AS (SELECT DISTINCT ref, 'concepts/' || replace(lower(idea), ' ', '-') AS id, idea AS name, [] AS lines FROM e_)
SELECT ref, id, sha256('# ' || name || chr(10) || chr(10) || '## References' || chr(10) || chr(10) || '- Mentioned in ' || ref) AS digest FROM i
UNION ALL SELECT ref, 'entities/' || lower(w), sha256('# ' || w || chr(10) || chr(10) || '## Context' || chr(10) || chr(10) || array_to_string(list_transform(list_concat(CASE WHEN regexp_matches(coalesce(description, ''), '(?i)(^|[^\\p{{L}}\\p{{N}}_])' || w || '($|[^\\p{{L}}\\p{{N}}_])') THEN [description] ELSE [] END, list_filter(said, lambda t: regexp_matches(t, '(?i)(^|[^\\p{{L}}\\p{{N}}_])' || w || '($|[^\\p{{L}}\\p{{N}}_])')))[1:3], lambda v: '- ' || {_FIELD.format('v')}), chr(10)) || chr(10) || chr(10) || '## References' || chr(10) || chr(10) || '- Mentioned in ' || ref)
  FROM (SELECT ref, description, said, words[k] AS w FROM (SELECT *, generate_subscripts(words, 1) AS k FROM e_) WHERE k <= 50 AND len(list_filter(words[:k - 1], lambda v: lower(v) = lower(words[k]))) = 0)""")
def x9_item_pages(spark, sf):
    return ingest.item_pages(extractions(spark, sf)).select("ref", "id", F.sha2("content", 256).alias("digest"))


@query("x7_duplicates", f"""WITH {MANIFEST}, o AS (SELECT key, value FROM manifest_ WHERE key NOT IN (SELECT ref FROM new_)), new_ AS (SELECT ref, hash FROM sources_ WHERE n % 2 = 0),
b AS (SELECT value, min(key) AS k FROM o GROUP BY 1), f AS (SELECT hash, min(ref) AS r FROM new_ GROUP BY 1) SELECT ref, coalesce(k, r) AS of FROM new_ JOIN f USING (hash) LEFT JOIN b ON value = hash WHERE coalesce(k, r) <> ref""".replace("o AS (SELECT key, value FROM manifest_ WHERE key NOT IN (SELECT ref FROM new_)), new_ AS (SELECT ref, hash FROM sources_ WHERE n % 2 = 0)", "new_ AS (SELECT ref, hash FROM sources_ WHERE n % 2 = 0), o AS (SELECT key, value FROM manifest_ WHERE key NOT IN (SELECT ref FROM new_))"))
def x7_duplicates(spark, sf):
    """Of the sources that come in now, those whose content is known under another name."""
    new = sources(spark, sf).where("n % 2 = 0").select("ref", "hash")
    return ingest.taken_in(new, manifest(spark, sf), extractions(spark, sf), pages(spark, sf), AS_OF)["duplicates"]


@query("x11_source_lines", f"""WITH {LINKS}, p AS (SELECT src AS ref, target AS id, min(CASE WHEN pos = 0 THEN 0 ELSE 1 END) AS late FROM links_ GROUP BY 1, 2) SELECT ref, '- `' || ref || '` → ' || string_agg('[[' || id || ']]', ', ' ORDER BY late, id) AS line FROM p GROUP BY 1""")
def x11_source_lines(spark, sf):
    pairs = links(spark, sf).select(F.col("src").alias("ref"), F.col("target").alias("id"), "pos")
    return ingest.source_lines(pairs.where("pos = 0"), pairs.where("pos > 0"))


@query("a10_overlaps", "WITH t AS (SELECT DISTINCT item_id AS id, unnest(list_filter(list_transform(string_split(regexp_replace(lower(text), '\\s+', ' ', 'g'), ' '), lambda w: trim(w, '.,!?()[]{}\"'':-/')), lambda w: length(w) > 4)) AS term FROM benchmark), k AS (SELECT term FROM t WHERE term NOT IN (" + ", ".join(f"'{w}'" for w in consistency.COMMON) + ") GROUP BY 1 HAVING count(*) BETWEEN 2 AND 200) SELECT x.id::VARCHAR AS a, y.id::VARCHAR AS b, count(*) AS shared FROM t x JOIN t y ON x.term = y.term AND x.id::VARCHAR < y.id::VARCHAR WHERE x.term IN (FROM k) GROUP BY 1, 2 HAVING count(*) >= 3")
def a10(spark, sf):
    """The benchmark's passages that share terms."""
    return consistency.overlapping(table(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("id"), F.col("text").alias("content")))


@query("l15_groups", f"""WITH {PAGES}, g AS (SELECT source AS grp, id FROM pages_), m AS (SELECT grp FROM g GROUP BY 1 HAVING count(*) > 1), k AS (SELECT grp, id, (row_number() OVER (PARTITION BY grp ORDER BY id) - 1) // 5 AS chunk FROM g WHERE grp IN (FROM m))
SELECT grp, chunk, string_agg(id, ',' ORDER BY id) AS ids FROM k GROUP BY 1, 2 HAVING count(*) > 1""")
def l15(spark, sf):
    """Pages of a source, in chunks; no other kinds of groups, which have SQL of their own."""
    p = pages(spark, sf)
    none = p.select("id", F.col("id").alias("component")).where("false")
    found = consistency.groups(p.select("id", F.col("source").alias("ref")), none, none.select(F.col("id").alias("a"), F.col("component").alias("b")))
    return found.select("grp", F.col("chunk").cast("long").alias("chunk"), F.array_join("ids", ",").alias("ids"))


@query("l15_contexts", f"WITH {PAGES} SELECT id, sha256('# Source Fidelity Check: ' || id || chr(10) || chr(10) || '## Page' || chr(10) || chr(10) || content || chr(10) || chr(10) || '## Sources' || chr(10) || chr(10) || '### raw/p' || (n % 40) || chr(10) || chr(10) || s.text || chr(10) || chr(10) || 'For each factual claim in the page, say whether it is **Traced**, **Inferred** or **Unsourced**.' || chr(10)) AS digest FROM pages_ JOIN benchmark s ON item_id = n % 40")
def l15_contexts(spark, sf):
    """Each page beside a passage that it cites."""
    p = pages(spark, sf)
    cited = p.select("id", F.concat(F.lit("raw/p"), (F.col("n") % 40).cast("string")).alias("ref"))
    raw = table(spark, sf, "benchmark").select(F.concat(F.lit("raw/p"), F.col("item_id").cast("string")).alias("ref"), F.col("text").alias("content"))
    return consistency.checks(p, cited, raw, "fidelity").where("size(missing) = 0").select("id", F.sha2("text", 256).alias("digest"))


@query("l13_callouts", "SELECT doc_id::VARCHAR AS id, length(t) - length(replace(t, chr(10), '')) + 2 AS line, 'stale' AS marker FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents) WHERE length(t) < 1000000")
def l13(spark, sf):
    p = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"), F.concat(F.coalesce("text", F.lit("")), F.lit("\n> [!STALE] see")).alias("content"))
    return lint.callouts(p)


@query("l14_checks", f"""WITH {EDGES} SELECT "check", n FROM (SELECT 'dead_link' AS "check", count(*) AS n FROM links_ WHERE target NOT IN (SELECT id FROM pages_)
UNION ALL SELECT 'orphan', count(*) FROM pages_ WHERE NOT {AUTO} AND id NOT IN (SELECT dst FROM edges_)
UNION ALL SELECT 'stub', count(*) FROM pages_ WHERE length(trim(content)) < 100 AND NOT {AUTO}
UNION ALL SELECT 'staleness', count(*) FROM pages_ WHERE CAST(updated AS DATE) < DATE '{AS_OF}' - 90
UNION ALL SELECT 'status_mature_stale', count(*) FROM pages_ WHERE status = 'mature' AND CAST(updated AS DATE) < DATE '{AS_OF}' - 90
UNION ALL SELECT 'frontmatter_stale', count(*) FROM pages_ WHERE n % 2 = 0
UNION ALL SELECT 'source_coverage', count(*) FROM (SELECT doc_id FROM documents WHERE 'raw/articles/d' || doc_id || '.md' NOT IN (SELECT source FROM pages_))
UNION ALL SELECT 'cycle', count(*) FROM edges_ a JOIN edges_ b ON b.src = a.dst AND b.dst = a.src WHERE a.src < a.dst) WHERE n > 0""")
def l14_checks(spark, sf):
    """Issues of the whole run by check, of the checks that find any on these pages; cycles of two pages, and slugs that look alike have queries of their own."""
    p, l, e = graph_of(spark, sf)
    dated = p.withColumn("file_day", F.when(F.col("n") % 2 == 0, F.date_add("updated", 1)).otherwise(F.to_date("updated")))
    found = lint.run_all(dated.withColumn("created", F.col("updated")).withColumn("title", F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.lit("t"))), l, e, AS_OF, sources(spark, sf).select("ref"), longest=2, slugs=False)
    return found.groupBy("check").agg(F.count("*").alias("n"))


@query("s2_fetch_limits")
def s2(spark, sf):
    calls = events(spark, sf).select(F.col("user_id").alias("run"), F.col("event_type").alias("host"), F.col("event_id").alias("entry"), F.col("ts").cast("long").alias("at"))
    return augment.fetch_limited(calls)


_STATE = "CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'proposed' WHEN 'click' THEN 'fetched' WHEN 'purchase' THEN 'done' ELSE 'failed' END"


@query("s5_transitions", f"""WITH l AS (SELECT user_id AS item, event_id AS nth, {_STATE} AS state, lag({_STATE}) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
SELECT nth, coalesce(CASE WHEN before IS NULL THEN state = 'pending' WHEN before IN ('done', 'failed') THEN false WHEN state = 'failed' THEN true ELSE (before, state) IN (('pending', 'proposed'), ('proposed', 'fetched')) END, false) AS legal FROM l""")
def s5_transitions(spark, sf):
    log = events(spark, sf).select(F.col("user_id").alias("item"), "ts", F.expr(_STATE).alias("state"), F.col("event_id").alias("nth"))
    return augment.advances(log).select("nth", "legal")


@query("s5_run_summary", f"""WITH l AS (SELECT user_id % 10 AS run, user_id AS item, arg_max({_STATE}, (ts, event_id)) AS state FROM events GROUP BY 1, 2)
SELECT run, count(*) AS examined, count(*) FILTER (state = 'done') AS succeeded, count(*) FILTER (state = 'abstained') AS abstained, count(*) FILTER (state = 'failed') AS failed, count(*) FILTER (state = 'cooldown') AS cooldown FROM l GROUP BY 1""")
def s5_run_summary(spark, sf):
    log = events(spark, sf).select((F.col("user_id") % 10).alias("run"), F.col("user_id").alias("item"), "ts", F.expr(_STATE).alias("state"), F.col("event_id").alias("nth"))
    return augment.run_summary(log)


@query("f5_fallbacks", f"WITH {PAGES} SELECT id, 'https://en.wikipedia.org/wiki/' || upper(left(replace(lower(trim(title)), ' ', '_'), 1)) || substr(replace(lower(trim(title)), ' ', '_'), 2) AS url FROM pages_ WHERE (id LIKE 'entities/%' OR id LIKE 'concepts/%') AND trim(title) <> ''")
def f5(spark, sf):
    return pages(spark, sf).select("id", augment.wikipedia(F.col("id"), F.col("title")).alias("url")).where("url IS NOT NULL")


@query("f6_quality", f"WITH {PAGES} SELECT id, CASE WHEN length(trim(content)) < 100 THEN 'fail' ELSE 'pass' END AS verdict FROM pages_")
def f6(spark, sf):
    return augment.quality(pages(spark, sf)).select("id", "verdict")


@query("f7_proposals", f"""WITH {PAGES} SELECT id, regexp_replace(regexp_replace(title, '[\\r\\n]', ' ', 'g'), '^\\s+|\\s+$', '', 'g') AS title, CASE WHEN n % 3 = 0 THEN 'abstain' ELSE 'propose' END AS action,
CASE WHEN n % 3 = 0 THEN '' ELSE 'https://a.org/' || n || ' https://b.org/' END AS urls, CASE WHEN n % 3 = 0 THEN 'none of ' || n ELSE NULL END AS reason, CASE WHEN n % 3 = 0 THEN NULL ELSE 'none of ' || n END AS rationale FROM pages_ WHERE regexp_replace(title, '\\s', '', 'g') <> ''""")
def f7(spark, sf):
    """Proposals written as files, one for every ten, and read again."""
    p = pages(spark, sf).where(r"regexp_replace(title, '\\s', '') <> ''")
    urls = F.when(F.col("n") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("https://a.org/"), F.col("n").cast("string")), F.lit("https://b.org/")))
    rows = p.select("id", "title", F.when(F.col("n") % 3 == 0, "abstain").otherwise("propose").alias("action"), urls.alias("urls"), F.concat(F.lit("none of "), F.col("n").cast("string")).alias("reason"), (F.col("n") % 10 + 1).alias("nth"), F.expr("cast(n div 10 as string)").alias("run"))
    return augment.proposals_of(augment.proposal_files(rows, AS_OF)).select("id", "title", "action", F.array_join("urls", " ").alias("urls"), "reason", "rationale")


@query("src10_fetched", "SELECT page_id, CASE WHEN regexp_matches(url, '^https?://([^/@]*@)?([^/]*\\.)?example\\.com([:/?#]|$)') THEN strlen(html) <= 5242880 ELSE false END AS inside FROM pages")
def src10(spark, sf):
    got = augment.fetched(table(spark, sf, "pages").select("url", "html"), ["example.com"]).select(F.col("url").alias("u"), "status").distinct()
    p = table(spark, sf, "pages").select("page_id", "url")
    return p.join(got, F.col("url") == F.col("u")).select("page_id", (~F.col("status").isin("blocked: domain", "blocked: scheme", "blocked: size")).alias("inside"))


@query("f4_captures")
def f4(spark, sf):
    """Whole conversations as inputs; the stub keeps their paragraphs."""
    c = table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n\n").alias("content"))
    inputs = c.withColumn("label", F.lit("talk")).withColumn("at", F.timestamp_seconds(F.col("id") * 120))
    taken = table(spark, sf, "benchmark").select(F.concat(F.lit("discovery-item-"), F.col("item_id").cast("string")).alias("slug"))
    return capture.capture(inputs, taken)[0].select("id", "nth", "slug", "kind")


@query("r12_answer")
def r12(spark, sf):
    p = pages(spark, sf)
    e = graph.edges(links(spark, sf), p)
    return answering.ask(p, QUESTION, models.stub, ranks=graph.pagerank(p, e, rounds=5, tol=0.0), raw=p.select("id", "content"), as_of=AS_OF).select("asked", "source_pages", "context_pages", "search_mode", "answer")


@query("a4_failing_pages", f"WITH {VERDICTS} SELECT DISTINCT page FROM verdicts_ WHERE verdict = 'fail'")
def a4(spark, sf):
    return records.failing(verdicts(spark, sf))


@query("p1_source_lists", f"WITH {PAGES} SELECT id, CASE n % 4 WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 0 END AS sources FROM pages_")
def p1_lists(spark, sf):
    """Sources named as a list of lines, one value, a list in brackets, and not at all."""
    head = F.expr("CASE n % 4 WHEN 0 THEN concat('title: x\nsource:\n  - raw/a.md\n  - \"raw/b.md\"\nstatus: seed') WHEN 1 THEN 'source: raw/a.md' WHEN 2 THEN 'source: [raw/a.md, \\'raw/b.md\\']\nx: y' ELSE 'title: none' END")
    return pages(spark, sf).select("id", F.size(text.listed(head, "source")).alias("sources"))
