"""Taking in sources: what a model extracts from them becomes summary pages, pages of entities and concepts, updates, index lines and a log.

Everything is a frame with a row for a source, an item or a page; a batch of any number of sources
is taken in at once. Nothing is written here: sources/writers.py does that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

#: Most items of a kind that a source may bring, most mentions in an item's context, bytes of an error in the log.
MOST, MENTIONS, ERROR = 50, 3, 2048
#: Fields that may hold an overview, and those that may hold claims, the first one counts; kinds of items in order.
OVERVIEWS, CLAIMS = ["core_argument", "abstract", "description", "problem_solved"], ["key_claims", "key_points", "key_arguments"]
KINDS = {"entities": "entities_mentioned", "concepts": "concepts_mentioned"}
#: Stages of the log, and what its outcome may say.
STAGES, OUTCOMES = ["start", "duplicate_skip", "success", "failure"], ["pages_created", "pages_updated", "pages_skipped", "error", "error_summary"]

#: What an extraction holds beside ref.
EXTRACTION = "ref string, title string, name string, author string, speaker string, authors array<string>, core_argument string, abstract string, description string, problem_solved string, key_claims array<string>, key_points array<string>, key_arguments array<string>, entities_mentioned array<string>, concepts_mentioned array<string>"


def _filled(c: Column) -> Column:
    """c, or null where it is blank."""
    return F.when(F.trim(c) != "", c)


def _first(names: list[str]) -> Column:
    return F.coalesce(*[_filled(F.col(n)) for n in names])


def claims() -> Column:
    """The claims of an extraction: the first field that is there, even if it is empty."""
    return F.coalesce(*[F.col(n) for n in CLAIMS])


def _named(c: Column) -> Column:
    """Whether a slug says anything."""
    return (c != "") & ~F.startswith(c, F.lit("untitled-"))


def _block(heading: str, lines: Column) -> Column:
    """A heading, its lines, and a blank line; null without lines."""
    return F.when(F.size(lines) > 0, F.concat(F.lit(f"\n## {heading}\n\n"), F.array_join(lines, "\n"), F.lit("\n")))


def _links(field: str, directory: str) -> Column:
    """Links to the pages of the named items of a field."""
    linked = F.transform(F.col(field), lambda x: F.struct(text.slug(x).alias("s"), text.display(x).alias("d")))
    return F.transform(F.filter(linked, lambda x: _named(x["s"])), lambda x: F.concat(F.lit(f"- [[{directory}/"), x["s"], F.lit("|"), x["d"], F.lit("]]")))


def summary() -> Column:
    """The text of a source's summary page."""
    title = F.coalesce(_first(["title", "name"]), F.lit("Untitled"))
    heading = F.concat(F.lit("# "), F.translate(F.replace(title, F.lit("\n"), F.lit(" ")), "\r", ""), F.lit("\n"))
    many = F.array_join(F.transform(F.filter("authors", lambda a: a.isNotNull()), lambda a: text.field(a)), ", ")
    by = F.when(F.size("authors") > 0, F.concat(F.lit("**Authors:** "), many, F.lit("\n"))).otherwise(F.concat(F.lit("**Author:** "), text.field(_first(["author", "speaker"])), F.lit("\n")))
    by = F.when((F.size("authors") > 0) | _first(["author", "speaker"]).isNotNull(), by)
    over = F.concat(F.lit("\n## Overview\n\n"), text.field(_first(OVERVIEWS)), F.lit("\n"))
    over = F.when(_first(OVERVIEWS).isNotNull(), over)
    said = _block("Key Claims", F.transform(claims(), lambda c: F.concat(F.lit("- "), text.field(c))))
    return F.concat_ws("\n", heading, by, over, said, _block("Entities Mentioned", _links("entities_mentioned", "entities")), _block("Concepts", _links("concepts_mentioned", "concepts")))


def items(extractions: DataFrame) -> DataFrame:
    """(ref, kind, nth, name, slug): the items of each source, the first MOST of a kind; of equal slugs the first stays, entities before concepts."""
    found = None
    for order, (kind, field) in enumerate(KINDS.items()):
        some = extractions.select("ref", F.lit(kind).alias("kind"), F.lit(order).alias("o"), F.posexplode(F.slice(F.col(field), 1, MOST)).alias("nth", "name"))
        found = some if found is None else found.union(some)
    found = found.withColumn("slug", text.slug("name")).where((F.trim("name") != "") & _named(F.col("slug")))
    first = found.groupBy("ref", "slug").agg(F.min_by(F.struct("kind", "nth", "name"), F.struct("o", "nth")).alias("x"))
    return first.select("ref", "x.kind", F.col("x.nth").alias("nth"), F.col("x.name").alias("name"), "slug")


def item_context(name: Column) -> Column:
    """A section of what the extraction says of an item, at most MENTIONS lines; empty if nothing."""
    pattern = F.concat(F.lit(r"(?i)(?<![\p{L}\p{N}_])\Q"), F.replace(name, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E(?![\p{L}\p{N}_])"))
    says = lambda c: F.regexp_like(c, pattern)
    over = F.slice(F.filter(F.array(*[_filled(F.col(n)) for n in OVERVIEWS]), lambda v: v.isNotNull() & says(v)), 1, 1)
    said = F.filter(F.coalesce(F.col("key_claims"), F.col("key_points"), F.array().cast("array<string>")), lambda c: c.isNotNull() & says(c))
    lines = F.transform(F.slice(F.concat(over, said), 1, MENTIONS), lambda v: F.concat(F.lit("- "), text.field(v)))
    return F.when(F.size(lines) > 0, F.concat(F.lit("## Context\n\n"), F.array_join(lines, "\n"))).otherwise("")


def item_pages(extractions: DataFrame, verb: str = "Mentioned") -> DataFrame:
    """(ref, id, title, content) of the page of each item, as a first source makes it."""
    rows = items(extractions).withColumnRenamed("ref", "r").join(extractions.withColumnRenamed("name", "own_name"), F.col("ref") == F.col("r"))
    name = F.translate(F.replace(F.col("name"), F.lit("\n"), F.lit(" ")), "\r", "")
    context = item_context(F.col("name"))
    body = F.concat_ws("\n", F.concat(F.lit("# "), name, F.lit("\n")), F.when(context != "", F.concat(context, F.lit("\n"))), F.lit("## References\n"), F.concat(F.lit(f"- {verb} in "), F.col("ref")))
    return rows.select("ref", F.concat("kind", F.lit("/"), "slug").alias("id"), name.alias("title"), body.alias("content"))


def with_reference(content: Column, line: Column) -> Column:
    """A page's references with a line added at their end, once; a page without the section gets it."""
    safe = F.regexp_replace(line, r"([\\$])", r"\\$1")
    has = content.rlike(r"(?m)^## References[ \t]*$")
    added = F.regexp_replace(content, r"(?s)(\n?## References[ \t]*\n(?:\n*- [^\n]*)*)", F.concat(F.lit("$1\n"), safe))
    return F.when(F.contains(content, line), content).when(has, added).otherwise(F.concat(content, F.lit("\n\n## References\n\n"), line))


def updates(found: DataFrame, pages: DataFrame, day: str, verb: str = "Mentioned") -> DataFrame:
    """(id, content, updated, new_sources): existing pages (id, content) that new sources name again.

    A page is written once, whatever the number of sources: their lines are gathered first.
    """
    from .edit import with_evidence

    named = found.groupBy("id").agg(F.array_sort(F.collect_set("ref")).alias("refs"))
    both = pages.select(F.col("id").alias("i"), "content").join(named, F.col("id") == F.col("i"))
    line = lambda r: F.concat(F.lit(f"- {verb} in "), r)
    fresh = F.filter("refs", lambda r: ~F.contains(F.col("content"), line(r)))
    body = with_reference(F.col("content"), F.array_join(F.transform("fresh", line), "\n"))
    proof = text.evidence_line(F.lit(day), F.array_join("fresh", ", "), F.lit(f"{verb} in new source"))
    return both.withColumn("fresh", fresh).where(F.size("fresh") > 0).select("id", with_evidence(body, proof).alias("content"), F.lit(day).alias("updated"), F.col("fresh").alias("new_sources"))


def source_lines(old: DataFrame, new: DataFrame) -> DataFrame:
    """(ref, line): every source and the pages that it gave, from pairs (ref, id) known before and new ones; taking a pair in again changes nothing."""
    tagged = old.select("ref", "id", F.lit(0).alias("late")).union(new.select("ref", "id", F.lit(1)))
    once = tagged.groupBy("ref", "id").agg(F.min("late").alias("late"))
    shown = once.groupBy("ref").agg(F.array_sort(F.collect_list(F.struct("late", "id"))).alias("p"))
    return shown.select("ref", F.concat(F.lit("- `"), F.replace(F.col("ref"), F.lit("`"), F.lit("\\`")), F.lit("` → "), F.array_join(F.transform("p", lambda x: F.concat(F.lit("[["), x["id"], F.lit("]]"))), ", ")).alias("line"))


def index_entries(pages: DataFrame) -> DataFrame:
    """(section, id, line) of the index, a section for each directory; derived anew, so it holds every page once."""
    directory = F.split("id", "/")[0]
    return pages.select(F.initcap(directory).alias("section"), "id", F.concat(F.lit("- [["), F.col("id"), F.lit("|"), text.display("title"), F.lit("]]")).alias("line")).dropDuplicates(["id"])


def audit(events: DataFrame) -> DataFrame:
    """(line): JSON of the log's events (ts, request_id, source_ref, source_hash, stage, outcome map); unknown stages are errors, unknown outcomes are left out, errors are cut to ERROR bytes and their paths hidden."""
    known = F.map_filter("outcome", lambda k, _: k.isin(OUTCOMES))
    # a cut inside a character would leave half of it: the rest of it goes too
    cut = lambda v: F.regexp_replace(F.decode(F.substring(F.encode(text.redacted_paths(v), "UTF-8"), 1, ERROR), "UTF-8"), "�+$", "")
    safe = F.transform_values(known, lambda k, v: F.when(F.startswith(k, F.lit("error")), cut(v)).otherwise(v))
    stage = F.when(F.col("stage").isin(STAGES), F.col("stage")).otherwise(F.raise_error(F.concat(F.lit("unknown stage "), F.coalesce("stage", F.lit("null")))))
    return events.select(F.to_json(F.struct("ts", "request_id", "source_ref", "source_hash", stage.alias("stage"), safe.alias("outcome"))).alias("line"))


def taken_in(sources: DataFrame, manifest: DataFrame, extractions: DataFrame, pages: DataFrame, day: str) -> dict[str, DataFrame]:
    """What a batch of sources (ref, hash) changes, given their extractions and the pages (id, title, content) as they are.

    Sources whose hash the manifest (key, value) has under another name, or that share one in the
    batch, are duplicates: the smallest ref stays. Returns frames: duplicates (ref, of), summaries
    and created pages (ref, id, title, content), updated pages, pairs (ref, id), and the new manifest rows.
    """
    others = manifest.join(sources.select("ref"), F.col("key") == F.col("ref"), "left_anti")
    before = others.groupBy(F.col("value").alias("v")).agg(F.min("key").alias("before"))
    first = sources.groupBy(F.col("hash").alias("h")).agg(F.min("ref").alias("own"))
    first = first.join(before, F.col("h") == F.col("v"), "left").select("h", F.coalesce("before", "own").alias("of")).hint("rebalance")
    named = sources.join(first, F.col("hash") == F.col("h"))
    duplicates = named.where(F.col("of") != F.col("ref")).select("ref", "of")
    fresh = extractions.join(named.where(F.col("of") == F.col("ref")).select(F.col("ref").alias("f")), F.col("ref") == F.col("f"), "left_semi")
    title = F.coalesce(_first(["title", "name"]), F.lit("Untitled"))
    summaries = fresh.select("ref", F.concat(F.lit("summaries/"), text.slug(title)).alias("id"), title.alias("title"), summary().alias("content"))
    made = item_pages(fresh)
    exists = pages.select(F.col("id").alias("i"))
    # of several sources that bring a page, the first makes it and the others add to it
    new = made.join(exists, F.col("id") == F.col("i"), "left_anti")
    created = new.groupBy("id").agg(F.min_by(F.struct("ref", "title", "content"), "ref").alias("x")).select("x.ref", "id", "x.title", "x.content")
    again = made.select("ref", "id").join(created.select(F.col("ref").alias("r"), F.col("id").alias("j")), (F.col("ref") == F.col("r")) & (F.col("id") == F.col("j")), "left_anti")
    changed = updates(again, pages.select("id", "content").union(created.select("id", "content")), day)
    pairs = summaries.select("ref", "id").union(made.select("ref", "id"))
    rows = named.select(F.col("ref").alias("key"), F.col("hash").alias("value"))
    return {"duplicates": duplicates, "summaries": summaries, "created": created, "updated": changed, "pairs": pairs, "manifest": rows}
