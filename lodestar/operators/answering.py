"""Answers to questions: search, context, coverage, a prompt, a model's reply and what it cites. One row for a question."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..session import saved
from . import models, retrieval

#: Characters of a context, of its summaries, of a question in the prompt; raw sources that fill in.
CONTEXT, SUMMARIES, QUESTION, RAW = 80_000, 12_000, 2000, 3
NOTHING = "No relevant pages found in the knowledge base for this question."


def rewritten(rows: DataFrame, model: Callable[[str], str]) -> DataFrame:
    """rows (question, talk) with `asked`: the question as it stands on its own, where the talk before it is needed and the model's reply is a safe one."""
    plain = F.trim(F.regexp_replace("question", r"\s+", " "))
    needs = text.should_rewrite(plain) & (F.trim(F.coalesce("talk", F.lit(""))) != "")
    prompt = F.when(needs, F.concat(F.lit("Rewrite the question so that it stands on its own.\n"), F.col("talk"), F.lit("\nQuestion: "), plain))
    asked = models.ask(rows.withColumn("prompt", prompt), "prompt", model)
    reply = F.trim("reply")
    return asked.withColumn("asked", F.when(F.coalesce(text.safe_rewrite(plain, reply), F.lit(False)), reply).otherwise(plain)).drop("prompt", "reply")


def rephrasings(question: Column, titles: Column, most: int = 3) -> Column:
    """Other questions, from the titles of what was found; titles that say what the question says are left out."""
    other = F.filter(titles, lambda t: (F.trim(t) != "") & (text.echo(t) != text.echo(question)))
    return F.transform(F.slice(F.array_distinct(other), 1, most), lambda t: F.concat(F.lit("What is known about "), t, F.lit("?")))


def ask(pages: DataFrame, question: str, model: Callable[[str], str] = models.stub, *, ranks: DataFrame | None = None, near: DataFrame | None = None, raw: DataFrame | None = None, purpose: str = "", talk: str = "", as_of: str = "1970-01-01", k: int = 10) -> DataFrame:
    """One row: question, asked, answer, citations, source_pages, context_pages, stale_citations, search_mode, coverage_confidence, low_confidence, rephrasings.

    near is (id, similarity) of pages, raw is (id, content) of raw sources, for a context without
    pages other than summaries. With a coverage under retrieval.COVERED no model is asked; without
    any page the answer says so.
    """
    spark = pages.sparkSession
    row = rewritten(spark.createDataFrame([(question, talk)], "question string, talk string"), model)
    asked = row.first()["asked"] if talk else " ".join(question.split())  # one row
    found = retrieval.search(pages, asked, ranks, k, near, as_of)
    found = saved(found.join(pages.withColumnRenamed("id", "i").drop("type", "score"), F.col("id") == F.col("i")).drop("i"), "hits")  # at most k rows
    inside = retrieval.context(found, CONTEXT, SUMMARIES, headed=True)
    part = inside.withColumnRenamed("id", "i").join(found.withColumn("section", retrieval.section()), F.col("id") == F.col("i"))
    part = part.withColumn("late", (F.col("type") != "summary").cast("int")).withColumn("section", F.expr("substring(section, 1, cast(taken as int))"))
    context = part.agg(F.array_sort(F.collect_list(F.struct("late", "rank", "id", "section", "type"))).alias("c"))
    shown = context.select(F.transform("c", lambda x: x["id"]).alias("context_pages"), F.array_join(F.transform("c", lambda x: x["section"]), "\n").alias("context"), F.forall("c", lambda x: x["type"] == "summary").alias("thin"))
    listed = found.agg(F.array_sort(F.collect_list(F.struct("rank", "id", "title", "stale"))).alias("f"))
    one = shown.join(F.broadcast(listed))  # one row each
    if raw is not None:
        hits = retrieval.top(retrieval.bm25(raw.withColumn("title", F.lit("")), asked, title=False).withColumn("score", F.round("score", 4)), RAW).join(raw, "id")
        ordered = hits.select(F.struct((-F.col("score")).alias("s"), "id", retrieval.section(raw=True).alias("section")).alias("x")).agg(F.array_sort(F.collect_list("x")).alias("raw"))
        budget = f"{CONTEXT} - length(context)"
        fits = F.expr(f"""aggregate(raw, named_struct('left', {budget}, 'full', false, 'out', cast(array() as array<string>)), (acc, x) ->
          CASE WHEN acc.full THEN acc WHEN length(x.section) <= acc.left THEN named_struct('left', acc.left - length(x.section), 'full', false, 'out', array_append(acc.out, x.section))
               WHEN size(acc.out) = 0 THEN named_struct('left', 0, 'full', true, 'out', array(substring(x.section, 1, acc.left))) ELSE named_struct('left', acc.left, 'full', true, 'out', acc.out) END).out""")
        one = one.join(F.broadcast(ordered)).withColumn("more", F.when(F.col("thin"), fits).otherwise(F.array().cast("array<string>")))  # one row
        one = one.withColumn("context", F.when(F.size("more") > 0, F.concat("context", F.lit("\n"), F.array_join("more", "\n"))).otherwise(F.col("context")))
    if near is not None:
        covered = part.select("id").join(retrieval.candidates(near, "similarity", 2 * k).select(F.col("id").alias("i")).join(near.select(F.col("id").alias("j"), "similarity"), F.col("i") == F.col("j")), F.col("id") == F.col("i"))
        one = one.join(F.broadcast(covered.agg(F.avg("similarity").alias("coverage_confidence"), F.count("*").alias("hits"))))  # one row
        one = one.withColumn("search_mode", F.when(F.col("hits") > 0, "hybrid").otherwise("bm25_only"))
    else:
        one = one.withColumn("coverage_confidence", F.lit(None).cast("double")).withColumn("search_mode", F.lit("bm25_only"))
    low = F.coalesce(F.col("coverage_confidence") < retrieval.COVERED, F.lit(False))
    focus = f"\nFOCUS:\n{purpose.strip()}\n" if purpose.strip() else ""
    prompt = F.concat(F.lit(f"Answer the question from the context only, citing pages as [[page]].{focus}\nQUESTION: {asked[:QUESTION]}\n\nCONTEXT:\n"), F.col("context"))
    empty = F.size("f") == 0
    replied = models.ask(one.withColumn("prompt", F.when(~low & ~empty, prompt)), "prompt", model)
    answer = F.when(empty, NOTHING).when(low, F.concat(F.lit("Coverage "), F.format_number("coverage_confidence", 2), F.lit(f" below threshold {retrieval.COVERED}. Consider rephrasing or widening the query."))).otherwise(F.col("reply"))
    stale = F.transform(F.filter("f", lambda x: x["stale"] & F.array_contains("context_pages", x["id"])), lambda x: x["id"])
    return replied.withColumn("answer", answer).select(
        F.lit(question).alias("question"), F.lit(asked).alias("asked"), "answer", F.when(empty, F.array().cast("array<struct<kind:string,path:string,context:string>>")).otherwise(text.citations("answer")).alias("citations"),
        F.transform("f", lambda x: x["id"]).alias("source_pages"), "context_pages", stale.alias("stale_citations"), "search_mode", "coverage_confidence", low.alias("low_confidence"),
        F.when(low, rephrasings(F.lit(asked), F.transform("f", lambda x: x["title"]))).otherwise(F.array().cast("array<string>")).alias("rephrasings"),
    )
