"""Machine-readable outputs of the pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import placed


def hidden() -> Column:
    """Pages that are never published."""
    return (F.lower("confidence") == "speculative") | F.lower("belief_state").isin("retracted", "contradicted")


def kept(pages: DataFrame) -> DataFrame:
    return pages.where(~F.coalesce(hidden(), F.lit(False)))


def index_lines(pages: DataFrame) -> DataFrame:
    """(type, id, line) of the index of kept pages; written with partitionBy('type') and sorted by id."""
    source = F.when(F.coalesce("source", F.lit("")) == "", "(no source)").otherwise(F.col("source"))
    return kept(pages).select("type", "id", F.concat(F.lit("- "), F.col("title"), F.lit(" — "), source, F.lit(" — "), F.col("updated")).alias("line"))


def index_text(pages: DataFrame) -> DataFrame:
    """(place, line) of the whole index: a heading for each type, its lines by id, and how many pages are left out."""
    lines = index_lines(pages).select("type", F.lit(1).alias("part"), "id", "line")
    heads = lines.select("type").distinct().select("type", F.lit(0).alias("part"), F.lit("").alias("id"), F.concat(F.lit("## "), F.col("type")).alias("line"))
    gone = pages.where(F.coalesce(hidden(), F.lit(False))).agg(F.count("*").alias("n")).where("n > 0")
    foot = gone.select(F.lit("\U0010ffff").alias("type"), F.lit(2).alias("part"), F.lit("").alias("id"), F.concat(F.lit("[!excluded] "), F.col("n").cast("string"), F.lit(" pages")).alias("line"))
    return placed(lines.union(heads).union(foot), ["type", "part", "id"]).select("place", "line")


def within_budget(pages: DataFrame, budget: int = 5 * 1024 * 1024) -> DataFrame:
    """(id, bytes): the pages, in order of id, that fit a budget of UTF-8 bytes, the first too large one cut.

    Running sums are taken inside ranges of ids, so the table is never sorted in one task. The
    result is as large as the budget.
    """
    sized = kept(pages).select("id", F.octet_length("content").cast("long").alias("n"))
    return placed(sized, ["id"], "start", of="n").where(F.col("start") < budget).select("id", F.least(F.col("n"), F.lit(budget) - F.col("start")).alias("bytes"))


def jsonld(pages: DataFrame, links: DataFrame) -> DataFrame:
    """(id, node): kept pages as JSON with the kept pages that they cite, in order, repeats and all."""
    k = kept(pages)
    cited = links.join(k.select(F.col("id").alias("k")), F.col("target") == F.col("k")).groupBy("src").agg(F.array_sort(F.collect_list(F.struct("pos", "target"))).alias("c"))
    node = k.join(cited, F.col("id") == F.col("src"), "left")
    return node.select("id", F.to_json(F.struct(F.lit("WebPage").alias("@type"), F.col("id").alias("@id"), F.coalesce(F.transform("c", lambda x: x["target"]), F.array().cast("array<string>")).alias("citation"))).alias("node"))


def siblings(pages: DataFrame) -> DataFrame:
    """(id, txt, json) of kept pages."""
    return kept(pages).select("id", F.concat(F.lit("# "), F.col("title"), F.lit("\n\n"), F.col("content")).alias("txt"), F.to_json(F.struct("authored_by", "belief_state", "confidence", "id", "source", "status", "title", "type", "updated")).alias("json"))


def xml_escaped(c) -> Column:
    for what, by in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(what), F.lit(by))
    return c


def sitemap(pages: DataFrame) -> DataFrame:
    """(id, entry) of kept pages; a page without a date has no lastmod."""
    day = F.when(F.coalesce("updated", F.lit("")) != "", F.concat(F.lit("<lastmod>"), xml_escaped(F.col("updated")), F.lit("</lastmod>"))).otherwise("")
    return kept(pages).select("id", F.concat(F.lit("<url><loc>pages/"), xml_escaped(F.col("id")), F.lit(".txt</loc>"), day, F.lit("</url>")).alias("entry"))
