"""Ranked search: BM25, nearest vectors, fusion, boosts, de-duplication and context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dates, text
from ..session import saved, ship

#: Weights of BM25, times a title counts, constant of the fusion.
K1, B, TITLE, RRF = 1.5, 0.75, 3, 60
#: Similarity from which results repeat, share of a type, results a page.
SAME, SHARE, A_PAGE = 0.85, 0.6, 2
#: Least similarity of a vector that counts, coverage below which no answer is given.
SIMILAR, COVERED = 0.3, 0.45


def postings(pages: DataFrame, title: bool = True) -> DataFrame:
    """(id, term, tf) with the title counted TITLE times."""
    found = text.tokens("content")
    if title:
        found = F.concat(F.flatten(F.array_repeat(text.tokens("title"), TITLE)), found)
    return pages.select("id", F.explode(found).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))


def equals(t: str):
    return lambda w: w == t


def question_terms(spark: SparkSession, question: str) -> list[str]:
    """The distinct tokens of a question, in order; one row of one question."""
    return spark.range(1).select(F.array_distinct(text.tokens(F.lit(question)))).first()[0]


def weight(total, df, tf, dl, avgdl) -> Column:
    """A term's share of a page's score."""
    return dates.idf(total, df) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / F.greatest(avgdl, F.lit(1e-9))))


def bm25(pages: DataFrame, question: str, title: bool = True) -> DataFrame:
    """(id, score) of pages with a score above zero.

    One pass over the texts keeps, for each page, its length and the counts of the question's
    terms; no posting of another term is ever shuffled. For many questions see write_index().
    """
    spark = pages.sparkSession
    terms = question_terms(spark, question)
    if not terms:
        return pages.select("id", F.lit(0.0).alias("score")).where("false")
    some = lambda c: F.filter(c, lambda w: w.isin(terms))
    docs = pages.select("id", text.tokens("content").alias("c"), (text.tokens("title") if title else F.array().cast("array<string>")).alias("h"))
    docs = docs.select("id", (F.size("c") + TITLE * F.size("h")).alias("dl"), some("c").alias("c"), some("h").alias("h"))
    docs = saved(docs.select("id", "dl", *[(F.size(F.filter("c", equals(t))) + TITLE * F.size(F.filter("h", equals(t)))).alias(f"t{i}") for i, t in enumerate(terms)]), "counts")
    stats = docs.agg(F.count("*").alias("total"), F.coalesce(F.avg("dl"), F.lit(1.0)).alias("avgdl"), *[F.sum((F.col(f"t{i}") > 0).cast("long")).alias(f"df{i}") for i in range(len(terms))])
    scored = docs.where(" OR ".join(f"t{i} > 0" for i in range(len(terms)))).join(F.broadcast(stats))  # one row
    parts = [F.when(F.col(f"t{i}") > 0, weight(F.col("total"), F.col(f"df{i}"), F.col(f"t{i}"), F.col("dl"), F.col("avgdl"))).otherwise(0.0) for i in range(len(terms))]
    return scored.select("id", sum(parts, F.lit(0.0)).alias("score")).where("score > 0")


def write_index(pages: DataFrame, path: str, title: bool = True, buckets: int = 64) -> None:
    """Postings (term, id, tf, dl) by buckets of terms, sorted by term, and one row of totals, as tables below path.

    Pages are read once, and a page's terms are counted where it is read; a row without a term stands for
    the page itself. A question reads the row groups of its own terms in their buckets.
    """
    import numpy as np
    import pyarrow as pa

    def counted(batches):
        for batch in batches:
            lists = batch.column(2)
            words = lists.flatten().dictionary_encode()
            size = np.diff(lists.offsets.to_numpy())
            many = max(1, len(words.dictionary))
            code = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            key, tf = np.unique(np.repeat(np.arange(batch.num_rows), size) * many + code, return_counts=True)
            # the row of a page itself comes after those of its terms
            own = pa.array(np.concatenate([key // many, np.arange(batch.num_rows)]))
            term = pa.concat_arrays([words.dictionary.take(pa.array(key % many)), pa.nulls(batch.num_rows, words.dictionary.type)])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(own), batch.column(1).take(own), term, pa.array(np.concatenate([tf, np.zeros(batch.num_rows, np.int64)]))], names=["id", "dl", "term", "tf"])

    ship(pages.sparkSession)
    found = text.tokens("content")
    if title:
        found = F.concat(F.flatten(F.array_repeat(text.tokens("title"), TITLE)), found)
    words = pages.select("id", found.alias("w")).select("id", F.size("w").alias("dl"), F.coalesce("w", F.array().cast("array<string>")).alias("w"))
    p = words.mapInArrow(counted, f"id {pages.schema['id'].dataType.simpleString()}, dl int, term string, tf long").withColumn("bucket", _bucket(F.coalesce("term", F.lit("")), buckets))
    # a bucket is cut by pages too, so that a frequent term is in many tasks
    p.repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(8))).sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    lengths = pages.sparkSession.read.parquet(f"{path}/postings").where((F.col("bucket") == _bucket(F.lit(""), buckets)) & F.col("term").isNull())
    lengths.agg(F.count("*").alias("total"), F.coalesce(F.avg("dl"), F.lit(1.0)).alias("avgdl"), F.lit(buckets).alias("buckets")).write.mode("overwrite").parquet(f"{path}/totals")


def _bucket(term, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def ask_index(spark: SparkSession, path: str, question: str) -> DataFrame:
    """(id, score) as bm25() gives them, from the tables that write_index() wrote."""
    totals = spark.read.parquet(f"{path}/totals")
    terms = question_terms(spark, question)
    if not terms:
        return spark.read.parquet(f"{path}/postings").select("id", F.lit(0.0).alias("score")).where("false")
    n = totals.first()["buckets"]  # one row
    spots = spark.createDataFrame([(t,) for t in terms], "t string").select(_bucket(F.col("t"), n)).collect()  # one for each term of the question
    hits = spark.read.parquet(f"{path}/postings").where(F.col("bucket").isin([r[0] for r in spots]) & F.col("term").isin(terms))
    often = hits.groupBy(F.col("term").alias("t")).agg(F.count("*").alias("df"))
    scored = hits.join(F.broadcast(often), F.col("term") == F.col("t")).join(F.broadcast(totals))  # a row for each term of the question, and one
    return scored.groupBy("id").agg(F.sum(weight(F.col("total"), F.col("df"), F.col("tf"), F.col("dl"), F.col("avgdl"))).alias("score"))


def top(df: DataFrame, k: int, score: str = "score", by: str = "id") -> DataFrame:
    return df.orderBy(F.desc(score), by).limit(k)


def distances(vectors: DataFrame, query: list[float] | DataFrame) -> DataFrame:
    """vectors with their L2 distance from a vector, or from the embedding of the only row of a frame; other dimensions and nulls are left out."""
    if isinstance(query, DataFrame):
        q = F.col("__q")
        vectors = vectors.join(F.broadcast(query.select(F.col("embedding").alias("__q")).limit(1)))  # one row, or none
    else:
        q = F.array(*[F.lit(float(x)) for x in query])
    far = F.sqrt(F.aggregate(F.zip_with("embedding", q, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
    return vectors.where(F.size("embedding") == F.size(q)).withColumn("distance", far).drop("__q")


def nearest(vectors: DataFrame, query: list[float] | DataFrame, k: int, places: int = 15) -> DataFrame:
    """(vec_id, distance) of the k nearest by L2, rounded before they are compared; of equal ones the smallest ids."""
    near = distances(vectors, query).withColumn("distance", F.round("distance", places))
    return near.orderBy("distance", "vec_id").limit(k)


def fused(lists: list[DataFrame], k: int = RRF) -> DataFrame:
    """(id, score) of lists (id, rank) with ranks from 0: sums of 1 / (k + rank)."""
    every = lists[0].select("id", "rank")
    for more in lists[1:]:
        every = every.union(more.select("id", "rank"))
    return every.groupBy("id").agg(F.sum(1 / (F.lit(k) + F.col("rank"))).alias("score"))


def boosted(df: DataFrame) -> DataFrame:
    """Mature and evergreen pages count 1.05 times, those with a human author 1.02 times."""
    s = F.col("score") * F.when(F.col("status").isin("mature", "evergreen"), 1.05).otherwise(1.0) * F.when(F.col("authored_by").isin("human", "hybrid"), 1.02).otherwise(1.0)
    return df.withColumn("score", s)


def deduped(results: DataFrame, jaccard: float = SAME, share: float = SHARE) -> DataFrame:
    """A bounded list of results (id, type, content, score) without repeats: the best row of a page, no text like one of its type before it, no type over its share.

    The rule depends on what was kept before, so it is a fold over the list in order of score. Rows
    without a type are compared with all others.
    """
    best = results.groupBy("id").agg(F.max_by(F.struct("type", "content"), F.struct("score", "content")).alias("b"), F.max("score").alias("score"))
    item = F.struct((-F.col("score")).alias("s"), "id", F.coalesce("b.type", F.lit("")).alias("type"), text.content_words("b.content").alias("w"))
    empty = "cast(array() as array<struct<s:double,id:string,type:string,w:array<string>>>)"
    kept = best.agg(F.array_sort(F.collect_list(item)).alias("rows")).select(F.expr(f"""
        aggregate(rows, {empty}, (acc, x) -> if(exists(acc, y -> (y.type = x.type OR y.type = '' OR x.type = '') AND size(array_union(x.w, y.w)) > 0
          AND size(array_intersect(x.w, y.w)) / size(array_union(x.w, y.w)) > {jaccard}), acc, array_append(acc, x)))""").alias("once"))  # fmt: skip
    quota = kept.select(F.expr(f"""
        aggregate(once, {empty}, (acc, x) -> if(size(filter(acc, y -> y.type = x.type)) >= greatest(1, cast(ceil((size(acc) + 1) * {share}) as int)), acc, array_append(acc, x)))""").alias("once"))  # fmt: skip
    return quota.select(F.posexplode("once").alias("rank", "x")).select("rank", F.col("x.id").alias("id"), F.col("x.type").alias("type"), (-F.col("x.s")).alias("score"))


def section(raw: bool = False) -> Column:
    """A result as a prompt shows it: a head that names it, and its text."""
    if raw:
        return F.concat(F.lit("--- Raw Source: "), F.col("id"), F.lit(" (verbatim) ---\n"), F.col("content"), F.lit("\n"))
    mark = F.when(F.coalesce(F.col("stale"), F.lit(False)), "[STALE] ").otherwise("")
    head = F.concat(F.lit("--- "), mark, F.lit("Page: "), F.col("id"), F.lit(" (type: "), F.coalesce("type", F.lit("unknown")), F.lit(", confidence: "), F.coalesce("confidence", F.lit("unknown")))
    return F.concat(head, F.lit(") ---\nTitle: "), F.col("title"), F.lit("\n\n"), F.col("content"), F.lit("\n"))


def context(results: DataFrame, limit: int = 80_000, tier: int = 12_000, headed: bool = False, stop: bool = False) -> DataFrame:
    """(id, taken): what fits of a bounded list (rank, id, type, content): summaries first within their tier, then others.

    A text that does not fit is skipped, or ends the list with `stop`; only the first of all may be
    cut to the limit. With `headed`, sizes are those of section(): rows need title, confidence and
    stale, a summary counts 100 characters for its head against the tier, which a first one may
    exceed, and a first text is only cut where more than its head fits.
    """
    whole = F.char_length(section()) if headed else F.char_length("content")
    item = F.struct(F.when(F.col("type") == "summary", 0).otherwise(1).alias("late"), "rank", "id", whole.cast("long").alias("n"), F.char_length("content").cast("long").alias("own"))
    rows = results.agg(F.array_sort(F.collect_list(item)).alias("rows"))
    late = f"x.late = 0 AND ({tier} <= acc.early OR (x.own + 100 > {tier} - acc.early AND size(acc.out) > 0))" if headed else f"x.late = 0 AND acc.used + x.n > {tier} AND size(acc.out) > 0 OR x.late = 0 AND acc.used + x.n > {tier} AND x.n <= {limit}"
    add = lambda n: f"named_struct('used', acc.used + {n}, 'early', acc.early + if(x.late = 0, {n}, 0L), 'full', acc.full, 'out', array_append(acc.out, named_struct('id', x.id, 'taken', {n})))"
    over = "named_struct('used', acc.used, 'early', acc.early, 'full', true, 'out', acc.out)" if stop else "acc"
    cut = f"size(acc.out) = 0 AND {limit} > x.n - x.own" if headed else "size(acc.out) = 0"
    step = rows.select(F.expr(f"""
        aggregate(rows, named_struct('used', 0L, 'early', 0L, 'full', false, 'out', cast(array() as array<struct<id:string,taken:bigint>>)), (acc, x) ->
          CASE WHEN acc.full OR ({late}) THEN acc
               WHEN acc.used + x.n <= {limit} THEN {add('x.n')}
               WHEN {cut} THEN {add(f'{limit}L - acc.used')}
               ELSE {over} END).out""").alias("out"))  # fmt: skip
    return step.select(F.inline("out"))


def stale_flags(results: DataFrame, as_of: str) -> DataFrame:
    """Adds stale: the newest source is younger than the page, or the page is older than its sources may be; pages without a date or a source are not."""
    day = F.try_to_date("updated")
    old = F.datediff(F.lit(as_of).cast("date"), day) > dates.decay_days(F.col("source"), F.col("title"))
    newer = F.coalesce(F.try_to_date("source_day") > day, F.lit(False)) if "source_day" in results.columns else F.lit(False)
    return results.withColumn("stale", F.coalesce((newer | old) & (F.coalesce("source", F.lit("")) != ""), F.lit(False)))


def candidates(hits: DataFrame, by: str, k: int) -> DataFrame:
    """(id, rank) of the k best hits; a list of k rows."""
    best = hits.orderBy(F.desc(by), "id").limit(k)
    return best.select("id", (F.row_number().over(Window.orderBy(F.desc(by), "id")) - 1).alias("rank"))


def similar(vectors: DataFrame, query: list[float] | DataFrame, least: float = SIMILAR) -> DataFrame:
    """(id, similarity) of vectors (id, embedding) that are similar enough."""
    near = distances(vectors, query).select("id", dates.similarity("distance").alias("similarity"))
    return near.where(F.col("similarity") >= least)


def asked_index(index, question: str, k: int, least: float = SIMILAR, embed=None, exact: bool = False) -> DataFrame:
    """(id, similarity) of the k pages of a vector index that are nearest to a question and similar enough.

    embed gives the vectors of a frame (id, content), as vectors.embedded() does, and must be what the index was
    built with. A question without terms has no direction, so no page is near it.
    """
    from . import vectors

    one = index.spark.createDataFrame([("", question)], "id string, content string")
    q = (embed or vectors.embedded)(one).first()["embedding"]  # one row
    if q is None or not any(q):
        return index.spark.createDataFrame([], "id string, similarity double")
    near = index.ask(q, k, exact=exact).select("id", F.round(dates.similarity("distance"), 9).alias("similarity"))
    return near.where(F.col("similarity") >= least)


def search(pages: DataFrame, question: str, ranks: DataFrame | None = None, k: int = 10, near: DataFrame | None = None, as_of: str | None = None) -> DataFrame:
    """The k best pages (rank, id, type, score): BM25, nearest vectors and page rank over the candidates of both, fused, boosted and without repeats.

    near is (id, similarity), as similar() gives it; ranks is (id, rank) of all pages. With as_of,
    pages come with stale. Lists have 2 * k rows at most, whatever the number of pages.
    """
    k = max(1, min(k, 100))
    lists = [candidates(bm25(pages, question).withColumn("score", F.round("score", 4)), "score", 2 * k)]
    if near is not None:
        lists.append(candidates(near, "similarity", 2 * k))
    if ranks is not None:
        # candidates keep the order in which they were found: BM25 first, then what only vectors found
        both = lists[0].select("id", F.col("rank").alias("at"))
        for more in lists[1:]:
            both = both.union(more.select("id", (F.col("rank") + 2 * k).alias("at")))
        both = both.groupBy("id").agg(F.min("at").alias("at"))
        r = both.join(ranks.select(F.col("id").alias("i"), F.col("rank").alias("pr")), F.col("id") == F.col("i"), "left")
        order = [F.desc(F.coalesce(F.round("pr", 12), F.lit(0.0))), "at"]
        lists.append(r.select("id", (F.row_number().over(Window.orderBy(*order)) - 1).alias("rank")).where(F.col("rank") < 2 * k))
    hits = fused(lists).withColumn("score", F.round("score", 12)).orderBy(F.desc("score"), "id").limit(2 * k)
    found = saved(hits.join(pages, "id"), "found")  # at most 2 * k rows
    best = deduped(boosted(found)).where(F.col("rank") < k)
    if as_of is None:
        return best
    flags = stale_flags(found, as_of).select(F.col("id").alias("i"), "stale")
    return best.join(F.broadcast(flags), F.col("id") == F.col("i")).drop("i")


def per_page(df: DataFrame, n: int = A_PAGE) -> DataFrame:
    """The first n results of each page."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "chunk"))).where(F.col("__r") <= n).drop("__r")
