"""Pages that may contradict each other, and texts for a reader to judge them by."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..session import placed

#: Words too common to tell pages apart.
COMMON = """
    about after again along based because before being between called could different during early every example first found great https
    index known large later level likely model never often other point right since small state still their there these thing those through
    title under until using value where which while would should above below might source content created updated stated
""".split()
#: Terms that pages must share, pages beyond which a term says nothing, pages of a group, groups of a report, characters of a page in it, characters of sources, and of one at least.
SHARED, NOISE, GROUP, GROUPS, SHOWN, SOURCES, FLOOR = 3, 200, 5, 20, 4096, 80_000, 500


def overlapping(pages: DataFrame, least: int = SHARED, noise: int = NOISE) -> DataFrame:
    """(a, b, shared): pages that share terms. A term of more than `noise` pages is left out, so its pairs are bounded; a < b."""
    t = pages.select("id", F.explode(text.overlap_terms(text.frontmatter("content")[1], COMMON)).alias("term"))
    few = t.groupBy(F.col("term").alias("k")).agg(F.count("*").alias("df")).where(f"df BETWEEN 2 AND {noise}").hint("rebalance")
    lists = t.join(few, F.col("term") == F.col("k"), "left_semi").groupBy("term").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    pairs = lists.select(F.explode(F.expr("flatten(transform(ids, (x, i) -> transform(slice(ids, i + 2, size(ids)), y -> named_struct('a', x, 'b', y))))")).alias("p"))
    return pairs.groupBy("p.a", "p.b").agg(F.count("*").alias("shared")).where(F.col("shared") >= least)


def groups(cited: DataFrame, components: DataFrame, pairs: DataFrame, size: int = GROUP) -> DataFrame:
    """(origin, grp, chunk, ids): groups of pages that share a source, that links connect, or that share terms, in chunks of 2 to `size`.

    cited is (id, ref), components (id, component), pairs (a, b). Of groups with the same pages the
    first kind stays. Chunks follow places over ranges, so a group of any size is never in one task.
    """
    rows = cited.select(F.lit(0).alias("origin"), F.col("ref").alias("grp"), "id").union(components.select(F.lit(1), "component", "id"))
    rows = rows.union(pairs.select(F.lit(2), F.concat_ws(" & ", "a", "b"), F.explode(F.array("a", "b")))).distinct()
    # equal groups have equal sums of hashes; a sum and a count stand for a group of any size
    marks = rows.groupBy("origin", "grp").agg(F.count("*").alias("n"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("h"), F.min("id").alias("low")).where("n > 1")
    once = marks.groupBy("n", "h", "low").agg(F.min(F.struct("origin", "grp")).alias("x")).select("x.origin", "x.grp")
    live = placed(rows.join(once, ["origin", "grp"], "left_semi"), ["origin", "grp", "id"])
    starts = live.groupBy(F.col("origin").alias("o"), F.col("grp").alias("g")).agg(F.min("place").alias("start")).hint("rebalance")
    nth = live.join(starts, (F.col("origin") == F.col("o")) & (F.col("grp") == F.col("g"))).withColumn("chunk", F.floor((F.col("place") - F.col("start")) / size))
    return nth.groupBy("origin", "grp", "chunk").agg(F.array_sort(F.collect_list("id")).alias("ids")).where("size(ids) > 1")


def report(chunks: DataFrame, pages: DataFrame, most: int = GROUPS) -> DataFrame:
    """(nth, ids, text) of the first `most` chunks: their pages' bodies, each cut to SHOWN characters, to be read for contradictions."""
    from pyspark.sql import Window

    first = chunks.orderBy("origin", "grp", "chunk").limit(most)  # a report of a fixed size
    first = first.withColumn("nth", F.row_number().over(Window.orderBy("origin", "grp", "chunk")))
    body = text.frontmatter("content")[1]
    cut = F.when(F.char_length(body) > SHOWN, F.concat(F.substring(body, 1, SHOWN), F.lit(f"\n\n[Truncated at {SHOWN} chars]"))).otherwise(body)
    member = first.select("nth", "ids", F.explode("ids").alias("id")).join(pages.select(F.col("id").alias("i"), cut.alias("body")), F.col("id") == F.col("i"), "left")
    shown = F.concat(F.lit("### "), F.col("id"), F.lit("\n\n"), F.coalesce("body", F.lit("*Page not found*")), F.lit("\n\n---\n"))
    parts = member.groupBy("nth", "ids").agg(F.array_sort(F.collect_list(F.struct("id", shown.alias("s")))).alias("p"))
    head = F.concat(F.lit("## Group "), F.col("nth").cast("string"), F.lit(" ("), F.size("ids").cast("string"), F.lit(" pages)\n\n"))
    return parts.select("nth", "ids", F.concat(head, F.array_join(F.transform("p", lambda x: x["s"]), "\n")).alias("text"))


#: What a reader is asked, by kind of check.
ASKED = {
    "fidelity": ("Source Fidelity Check", "For each factual claim in the page, say whether it is **Traced**, **Inferred** or **Unsourced**."),
    "completeness": ("Completeness Check", "List key claims, facts or arguments of the sources that are NOT represented in the page."),
    "review": ("Review", "Check: claims traced to sources; no contradictions; links valid; metadata complete; summary accurate. Answer with issues (severity, type, description, suggested_fix)."),
}


def checks(pages: DataFrame, cited: DataFrame, sources: DataFrame, kind: str) -> DataFrame:
    """(id, missing, text): each page (id, content) beside the sources (ref, content) that it cites (id, ref), for one of the kinds of ASKED.

    Sources share a budget of SOURCES characters in order of their names: one that does not fit is
    cut, to FLOOR characters at least. Cited sources that are not there are named in missing.
    """
    title, asked = ASKED[kind]
    refs = cited.join(sources.select(F.col("ref").alias("r"), F.col("content").alias("source")), F.col("ref") == F.col("r"), "left")
    listed = refs.groupBy("id").agg(F.array_sort(F.collect_set(F.struct("ref", F.substring("source", 1, SOURCES).alias("body"), F.char_length("source").alias("n")))).alias("s"))
    rows = pages.select("id", "content").join(listed.withColumnRenamed("id", "i"), F.col("id") == F.col("i"), "left")
    # budget left before each source: what stands before it, cut as it was
    shown = F.expr(f"""aggregate(filter(coalesce(s, array()), x -> x.body IS NOT NULL), named_struct('left', {SOURCES}, 'out', cast(array() as array<string>)), (acc, x) ->
      named_struct('left', greatest(0, acc.left - least(x.n, greatest({FLOOR}, acc.left))), 'out', array_append(acc.out, concat('### ', x.ref, '\\n\\n', substring(x.body, 1, greatest({FLOOR}, acc.left)),
        if(x.n > greatest({FLOOR}, acc.left), '\\n[truncated]', ''), '\\n')))).out""")
    missing = F.transform(F.filter(F.coalesce("s", F.expr("cast(array() as array<struct<ref:string,body:string,n:int>>)")), lambda x: x["body"].isNull()), lambda x: x["ref"])
    whole = F.concat(F.lit(f"# {title}: "), F.col("id"), F.lit("\n\n## Page\n\n"), F.col("content"), F.lit("\n\n## Sources\n\n"), F.array_join(shown, "\n"), F.lit(f"\n{asked}\n"))
    return rows.select("id", missing.alias("missing"), whole.alias("text"))

