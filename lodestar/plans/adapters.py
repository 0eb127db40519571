"""Canonical frames of the library, derived from the supplied tables by arithmetic on keys.

Each adapter has a twin in SQL (a CTE that DuckDB runs), so that a query and its check start from
the same rows. Supplied documents have no links or metadata; both are derived from doc_id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The day that every query takes for today, and the hour for now.
AS_OF = "2025-01-15"
NOW = "2024-01-31 00:00:00"

#: Directories and the page types in them.
DIRS = ["entities", "concepts", "comparisons", "summaries", "synthesis"]
TYPES = ["entity", "concept", "comparison", "summary", "synthesis"]
CONFIDENCE = ["stated", "inferred", "speculative"]
STATUS = ["seed", "developing", "mature", "evergreen"]
BELIEF = ["confirmed", "uncertain", "contradicted", "stale", "retracted"]
AUTHORED = ["human", "llm", "hybrid"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: list[str], by):
    """The element of values at by (from 0)."""
    return F.element_at(F.array(*map(F.lit, values)), (by + 1).cast("int"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page for each document."""
    d = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        d.alias("n"), F.concat(pick(DIRS, d % 5), F.lit("/doc-"), d.cast("string")).alias("id"), pick(TYPES, d % 5).alias("type"),
        F.substring(F.split(F.coalesce("text", F.lit("")), "\n")[0], 1, 60).alias("title"), F.coalesce("text", F.lit("")).alias("content"),
        F.concat(F.lit("raw/articles/"), F.coalesce("source", F.lit("none")), F.lit(".md")).alias("source"),
        F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (d % 400).cast("int")), "yyyy-MM-dd").alias("updated"),
        pick(CONFIDENCE, d % 3).alias("confidence"), pick(STATUS, d % 4).alias("status"), pick(BELIEF, (d / 3).cast("long") % 5).alias("belief_state"),
        pick(AUTHORED, (d / 2).cast("long") % 3).alias("authored_by"),
    )


def _sql_pick(values: list[str], by: str) -> str:
    return f"(['{"', '".join(values)}'])[CAST({by} AS INT) + 1]"


PAGES = f"""pages_ AS (SELECT doc_id AS n, {_sql_pick(DIRS, 'doc_id % 5')} || '/doc-' || doc_id AS id, {_sql_pick(TYPES, 'doc_id % 5')} AS type,
  substr(string_split(coalesce(text, ''), chr(10))[1], 1, 60) AS title, coalesce(text, '') AS content, 'raw/articles/' || coalesce(source, 'none') || '.md' AS source,
  strftime(DATE '2024-01-01' + CAST(doc_id % 400 AS INT), '%Y-%m-%d') AS updated, {_sql_pick(CONFIDENCE, 'doc_id % 3')} AS confidence, {_sql_pick(STATUS, 'doc_id % 4')} AS status,
  {_sql_pick(BELIEF, '(doc_id // 3) % 5')} AS belief_state, {_sql_pick(AUTHORED, '(doc_id // 2) % 3')} AS authored_by FROM documents)"""


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, pos, target) of every page's links: some to bare slugs, some broken."""
    d = F.col("n")
    docs = pages(spark, sf_dir).select("n", "id")
    total = docs.agg(F.max("n").alias("top"))
    name = lambda x: F.concat(pick(DIRS, x % 5), F.lit("/doc-"), x.cast("string"))
    a, b = (7 * d + 3) % (F.col("top") + 1), (13 * d + 5) % (F.col("top") + 1)
    targets = F.array(
        F.struct(F.lit(0).alias("pos"), F.when(d % 11 == 0, F.concat(F.lit("doc-"), a.cast("string"))).otherwise(name(a)).alias("target")),
        F.struct(F.lit(1).alias("pos"), F.when(d % 3 == 0, name(b)).alias("target")),
        F.struct(F.lit(2).alias("pos"), F.when(d % 17 == 0, F.concat(F.lit("concepts/missing-"), (d % 50).cast("string"))).alias("target")),
    )
    # one row of totals: its size is fixed
    return docs.join(F.broadcast(total)).select(F.col("id").alias("src"), F.explode(targets).alias("l")).select("src", "l.pos", "l.target").where("target IS NOT NULL")


def _name(x: str) -> str:
    return f"{_sql_pick(DIRS, f'({x}) % 5')} || '/doc-' || ({x})"


_A, _B = "(7 * n + 3) % (SELECT max(doc_id) + 1 FROM documents)", "(13 * n + 5) % (SELECT max(doc_id) + 1 FROM documents)"
LINKS = f"""{PAGES}, links_ AS (
  SELECT id AS src, 0 AS pos, CASE WHEN n % 11 = 0 THEN 'doc-' || ({_A}) ELSE {_name(_A)} END AS target FROM pages_
  UNION ALL SELECT id, 1, {_name(_B)} FROM pages_ WHERE n % 3 = 0
  UNION ALL SELECT id, 2, 'concepts/missing-' || (n % 50) FROM pages_ WHERE n % 17 = 0)"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entry, ts, page, rating, question, notes) of ratings given to pages."""
    rating = F.when(F.col("event_type").isin("purchase", "click", "view"), "useful").when(F.col("event_type") == "error", "wrong").otherwise("incomplete")
    return events(spark, sf_dir).select(F.col("event_id").alias("entry"), "ts", F.concat(F.lit("page-"), F.col("user_id").cast("string")).alias("page"), rating.alias("rating"), F.concat(F.lit("q"), (F.col("event_id") % 97).cast("string")).alias("question"), F.coalesce("props", F.lit("")).alias("notes"))


FEEDBACK = """feedback_ AS (SELECT event_id AS entry, ts, 'page-' || user_id AS page, CASE WHEN event_type IN ('purchase', 'click', 'view') THEN 'useful' WHEN event_type = 'error' THEN 'wrong' ELSE 'incomplete' END AS rating,
  'q' || (event_id % 97) AS question, coalesce(props, '') AS notes FROM events)"""


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entry, ts, page, verdict, verdict_type) of checks of pages."""
    verdict = F.when(F.col("event_type").isin("purchase", "click"), "pass").when(F.col("event_type") == "error", "fail").when(F.col("event_type") == "view", "warning").otherwise("unknown")
    return events(spark, sf_dir).select(F.col("event_id").alias("entry"), "ts", F.concat(F.lit("page-"), F.col("user_id").cast("string")).alias("page"), verdict.alias("verdict"), pick(["fidelity", "consistency", "completeness", "review"], F.col("event_id") % 4).alias("verdict_type"))


VERDICTS = f"""verdicts_ AS (SELECT event_id AS entry, ts, 'page-' || user_id AS page, CASE WHEN event_type IN ('purchase', 'click') THEN 'pass' WHEN event_type = 'error' THEN 'fail' WHEN event_type = 'view' THEN 'warning' ELSE 'unknown' END AS verdict,
  {_sql_pick(['fidelity', 'consistency', 'completeness', 'review'], 'event_id % 4')} AS verdict_type FROM events)"""


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ref, kind, hash) of raw sources as they are now: one for each document."""
    d = F.col("doc_id")
    text = F.regexp_replace(F.coalesce("text", F.lit("")), "\r\n?", "\n")
    return table(spark, sf_dir, "documents").select(F.concat(F.lit("raw/articles/d"), d.cast("string"), F.lit(".md")).alias("ref"), pick(["article", "paper", "repo"], d % 3).alias("kind"), d.alias("n"), F.substring(F.sha2(text, 256), 1, 32).alias("hash"))


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, value): what was known of sources before: some changed, some failed, some gone since."""
    now = sources(spark, sf_dir).where("n % 10 < 8")
    value = F.when(F.col("n") % 7 == 0, F.concat(F.lit("x"), F.substring("hash", 2, 31))).when(F.col("n") % 23 == 0, F.concat(F.lit("failed:"), "hash")).when(F.col("n") % 29 == 0, F.concat(F.lit("in_progress:"), "hash")).otherwise(F.col("hash"))
    ghosts = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("raw/papers/b"), F.col("item_id").cast("string"), F.lit(".md")).alias("key"), F.lit("0" * 32).alias("value"))
    return now.select(F.col("ref").alias("key"), value.alias("value")).union(ghosts)


MANIFEST = f"""sources_ AS (SELECT 'raw/articles/d' || doc_id || '.md' AS ref, {_sql_pick(['article', 'paper', 'repo'], 'doc_id % 3')} AS kind, doc_id AS n,
  substr(sha256(regexp_replace(coalesce(text, ''), '\\r\\n?', chr(10), 'g')), 1, 32) AS hash FROM documents),
manifest_ AS (SELECT ref AS key, CASE WHEN n % 7 = 0 THEN 'x' || substr(hash, 2, 31) WHEN n % 23 = 0 THEN 'failed:' || hash WHEN n % 29 = 0 THEN 'in_progress:' || hash ELSE hash END AS value FROM sources_ WHERE n % 10 < 8
  UNION ALL SELECT 'raw/papers/b' || item_id || '.md', '{"0" * 32}' FROM benchmark)"""
