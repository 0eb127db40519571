"""Rules over pages and links. Every rule is a frame; rules on pages share the columns of an issue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..plans.adapters import AUTHORED, BELIEF, CONFIDENCE, STATUS, TYPES
from ..session import only, saved

#: Directories that are made by machine, least characters of a page, largest distance of slugs that look alike.
AUTOGEN = ["summaries/", "comparisons/", "synthesis/"]
STUB, ALIKE = 100, 3
#: Files at the root that links may name.
ROOT_FILES = ["index", "_sources", "log"]


def autogen(page: Column) -> Column:
    out = F.lit(False)
    for prefix in AUTOGEN:
        out = out | F.startswith(page, F.lit(prefix))
    return out


def issues(df: DataFrame, check: str, severity: str, page: str = "id", target=None, message=None) -> DataFrame:
    return df.select(F.lit(check).alias("check"), F.lit(severity).alias("severity"), F.col(page).alias("page"), (F.lit("") if target is None else target).alias("target"), (F.lit("") if message is None else message).alias("message"))


def frontmatter_errors() -> Column:
    """Errors of a page's metadata, in a fixed order."""
    c, found = F.col, []
    for name in ("title", "source", "created", "updated", "type", "confidence"):
        found.append(F.when(F.coalesce(F.trim(c(name)), F.lit("")) == "", f"missing {name}"))
    for name in ("created", "updated"):
        found.append(F.when(F.try_to_date(c(name)).isNull() & (F.coalesce(c(name), F.lit("")) != ""), f"invalid {name}"))
    for name, values in (("type", TYPES), ("confidence", CONFIDENCE), ("belief_state", BELIEF), ("authored_by", AUTHORED), ("status", STATUS)):
        found.append(F.when((F.coalesce(c(name), F.lit("")) != "") & ~c(name).isin(values), f"invalid {name}"))
    return F.array_compact(F.array(*found))


def page_id_fault(page: Column) -> Column:
    """Why an id is refused, or null."""
    reserved = page.rlike(r"(?i)(^|/)(con|prn|aux|nul|com[1-9]|lpt[1-9])(\.[^/]*)?(/|$)")
    return F.when(page.rlike(r"[\x00-\x1f\x7f]"), "control characters").when(F.trim(page) == "", "empty").when(F.char_length(page) > 200, "too long").when(F.contains(page, F.lit("..")), "climbs").when(page.rlike(r"^([/\\]|[A-Za-z]:)"), "absolute").when(reserved, "reserved")


def feedback_fault(rating: Column, question: Column, notes: Column) -> Column:
    """Why a rating is refused, or null."""
    return F.when(~F.coalesce(rating.isin("useful", "wrong", "incomplete"), F.lit(False)), "unknown rating").when(F.trim(F.coalesce(question, F.lit(""))) == "", "no question").when(F.char_length(question) > 2000, "question too long").when(F.char_length(notes) > 2000, "notes too long")


def run_id_fault(run: Column) -> Column:
    """Why the id of a run is refused, or null."""
    return F.when(~F.coalesce(run.rlike(r"\A[0-9a-f]{8}\z"), F.lit(False)), "not eight hexadecimal digits")


def dead_links(links: DataFrame, pages: DataFrame) -> DataFrame:
    """Links whose exact target is no page and no root file; repeated links stay."""
    live = links.where(~F.col("target").isin(ROOT_FILES))
    return issues(live.join(pages.select(F.col("id").alias("p")), F.col("target") == F.col("p"), "left_anti"), "dead_link", "error", "src", F.col("target"))


def orphans(pages: DataFrame, edges: DataFrame) -> DataFrame:
    """Pages without links to them: isolated ones have none of their own either."""
    ins = edges.select(F.col("dst").alias("x")).distinct()
    outs = edges.select(F.col("src").alias("y")).distinct()
    lone = pages.where(~autogen(F.col("id"))).select("id").join(ins, F.col("id") == F.col("x"), "left_anti").join(outs, F.col("id") == F.col("y"), "left")
    return issues(lone, "orphan", "warning", message=F.when(F.col("y").isNull(), "isolated").otherwise("no inbound"))


def stubs(pages: DataFrame) -> DataFrame:
    return issues(pages.where((F.char_length(F.trim(F.col("content"))) < STUB) & ~autogen(F.col("id"))), "stub", "info")


def stale(pages: DataFrame, as_of: str, days: int = 90) -> DataFrame:
    """Pages with no date (warning) or an old one (info); malformed dates are left to the metadata rule."""
    day = F.try_to_date("updated")
    empty = F.coalesce(F.trim("updated"), F.lit("")) == ""
    found = F.when(empty, "warning").when(day < F.date_sub(F.lit(as_of).cast("date"), days), "info")
    return pages.withColumn("severity", found).where("severity IS NOT NULL")


def mature_stale(pages: DataFrame, as_of: str) -> DataFrame:
    return issues(pages.where((F.col("status") == "mature") & (F.try_to_date("updated") < F.date_sub(F.lit(as_of).cast("date"), 90))), "status_mature_stale", "warning")


def authored_drift(pages: DataFrame) -> DataFrame:
    """Pages by people whose evidence section says that a machine wrote to them."""
    section = F.regexp_extract("content", r"(?s)(?:^|\n)## Evidence Trail\s*(.*?)(?:\n## |\z)", 1)
    return issues(pages.where((F.col("authored_by") == "human") & section.rlike(r"action:\s*ingest")), "authored_by_drift", "warning")


def source_coverage(refs: DataFrame, cited: DataFrame) -> DataFrame:
    """Raw sources that no page cites."""
    return refs.join(cited.select(F.col("ref").alias("c")).distinct(), F.col("ref") == F.col("c"), "left_anti")


#: Longest slug that is compared by deletions; shortest slugs of which strings of 4 and of 5 characters are compared.
SHORT, FOUR, FIVE = 12, 16, 32
#: Strings of a slug that are looked up: one more than edits can spoil.
KEYS = ALIKE + 1


def _grams(s: DataFrame, q: str, where: str) -> DataFrame:
    """s (.., s, n) with (at, g): all strings of q characters, as numbers; two that share one by chance only meet in vain."""
    made = f"transform(sequence(1, n - {q} + 1), i -> xxhash64(substring(s, cast(i as int), {q})))"
    return s.where(where).select(*s.columns, F.posexplode(F.expr(made)).alias("at", "g"))


def _named(ids: DataFrame) -> DataFrame:
    """(id, s) of every id and the slug that is compared, as a table."""
    return saved(ids.select("id", F.lower(F.replace("id", F.lit("_"), F.lit("-"))).alias("s")).distinct(), "ids")


def _met(named: DataFrame) -> DataFrame:
    """(s, s2) of slugs that are to be measured, s before s2; a pair may come more than once."""
    slugs = named.select("s").distinct().select("s", F.char_length("s").alias("n"))
    slugs = saved(slugs.withColumn("v", F.monotonically_increasing_id()), "slugs")
    s = slugs.select("s", "n")
    own = f"(CASE WHEN n < {FOUR} THEN 3 WHEN n < {FIVE} THEN 4 ELSE 5 END)"
    # strings of every length that a slug of a near length may be looked up by
    every = [_grams(s, str(q), f"n > {SHORT} AND n BETWEEN {low} AND {high}") for q, low, high in ((3, 0, FOUR - 1 + ALIKE), (4, FOUR - ALIKE, FIVE - 1 + ALIKE), (5, FIVE - ALIKE, 1 << 30))]
    grams = every[0].unionByName(every[1]).unionByName(every[2])
    often = grams.groupBy(F.col("g").alias("k")).agg(F.count("*").alias("df")).hint("merge")
    # numbers stand for slugs and strings where every string is shuffled; a small table of slugs has many strings, too many to broadcast
    mine = _grams(slugs, own, f"n > {SHORT}").select("v", "n", "at", "g").join(often, F.col("g") == F.col("k"))
    listed = mine.groupBy("v", "n").agg(F.array_sort(F.collect_list(F.struct("df", "g", "at"))).alias("p")).withColumn("q", F.expr(own))
    # of every way to begin, strings one after another do not overlap, so an edit spoils one of them at most; the way of which KEYS are rarest
    tiles = f"slice(filter(p, x -> x.at % q = o), 1, {KEYS})"
    ways = F.expr(f"filter(transform(sequence(0, q - 1), o -> named_struct('worst', try_element_at({tiles}, {KEYS}).df, 'tiles', {tiles})), y -> y.worst IS NOT NULL)")
    best = listed.select(F.col("v").alias("w"), F.array_min(ways)["tiles"].alias("tiles"))
    chosen = saved(best.join(slugs, F.col("w") == F.col("v")).select("s", "n", "tiles"), "keys")
    keys = chosen.select("s", "n", F.explode("tiles").alias("x")).select("s", "n", F.col("x.g").alias("g"), F.col("x.at").alias("at"))
    other = grams.select(F.col("s").alias("s2"), F.col("n").alias("n2"), F.col("g").alias("g2"), F.col("at").alias("at2"))
    near = (F.abs(F.col("n") - F.col("n2")) <= ALIKE) & (F.abs(F.col("at") - F.col("at2")) <= ALIKE) & (F.col("s") < F.col("s2"))
    # most strings are no key
    met = only(other, keys.hint("merge"), "g2", "g").where(near).select("s", "s2")
    # every way to leave out up to ALIKE characters of a short slug
    less = "array_distinct(flatten(transform({}, w -> array_union(array(w), transform(sequence(1, greatest(length(w), 1)), i -> concat(substring(w, 1, cast(i - 1 as int)), substring(w, cast(i + 1 as int), length(w))))))))"
    left = "array(s)"
    for _ in range(ALIKE):
        left = less.format(left)
    few = s.where(F.col("n") <= SHORT + ALIKE).select("s", "n", F.explode(F.expr(f"transform({left}, w -> xxhash64(w))")).alias("d"))
    few2 = few.select(*[F.col(c).alias(f"{c}2") for c in few.columns]).hint("merge")
    short = few.join(few2, (F.col("d") == F.col("d2")) & (F.least("n", "n2") <= SHORT) & (F.abs(F.col("n") - F.col("n2")) <= ALIKE) & (F.col("s") < F.col("s2"))).select("s", "s2")
    return met.union(short)


def _of_ids(pairs: DataFrame, named: DataFrame) -> DataFrame:
    """pairs (s, s2, ..) of slugs as pairs of their ids (id, s, id2, s2, ..), the smaller id first."""
    rest = [c for c in pairs.columns if c not in ("s", "s2")]
    a, b = named.select(F.col("id").alias("__a"), F.col("s").alias("__s")), named.select(F.col("id").alias("__b"), F.col("s").alias("__s2"))
    both = pairs.join(a, F.col("s") == F.col("__s")).join(b, F.col("s2") == F.col("__s2"))
    first, last = F.struct(F.col("__a").alias("id"), "s"), F.struct(F.col("__b").alias("id"), F.col("s2").alias("s"))
    both = both.select(F.least(first, last).alias("x"), F.greatest(first, last).alias("y"), *rest)
    return both.select("x.id", "x.s", F.col("y.id").alias("id2"), F.col("y.s").alias("s2"), *rest)


def alike_candidates(ids: DataFrame) -> DataFrame:
    """(id, s, id2, s2): the pairs that alike_slugs() measures, each once."""
    named = _named(ids)
    return _of_ids(_met(named).distinct(), named)


def alike_slugs(ids: DataFrame) -> DataFrame:
    """(id, id2, distance): pairs of ids at an edit distance of 1 to ALIKE.

    ALIKE edits spoil at most ALIKE of a slug's strings that do not overlap, so of any KEYS of them one
    stands in the other slug, moved by at most ALIKE places. The rarest ones are looked up, by equal
    joins, so what many slugs share, such as a prefix, is no key as long as KEYS strings lie outside it;
    where they don't, a shared one is a key, and the slugs that share it are all compared. Slugs of up to
    SHORT characters have too few strings; they and slugs up to ALIKE longer meet in what is left of them
    after deletions. Pairs are measured where they meet, so only those that are alike are shuffled.
    """
    named = _named(ids)
    alike = _met(named).withColumn("distance", F.levenshtein("s", "s2", ALIKE)).where(f"distance BETWEEN 1 AND {ALIKE}").distinct()
    return _of_ids(alike, named).select("id", "id2", "distance")


#: Callouts of a page, and of a report.
CALLOUTS, ALL_CALLOUTS = 500, 10_000


def callouts(pages: DataFrame) -> DataFrame:
    """(id, line, marker): the first CALLOUTS of each page; a page with more has a row "__truncated__" of line 0 after them."""
    found = pages.select("id", text.callouts("content").alias("c"))
    more = F.array(F.struct(F.lit(0).alias("line"), F.lit("__truncated__").alias("marker")))
    cut = F.when(F.size("c") > CALLOUTS, F.concat(F.slice("c", 1, CALLOUTS), more)).otherwise(F.col("c"))
    return found.select("id", F.explode(cut).alias("c")).select("id", F.col("c.line").cast("long").alias("line"), F.col("c.marker").alias("marker"))


def callout_report(pages: DataFrame, most: int = ALL_CALLOUTS) -> DataFrame:
    """The first `most` callouts in order of page and line, and a row "__truncated__" if there are more: a report of a fixed size."""
    rows = callouts(pages).orderBy("id", (F.col("marker") == "__truncated__").cast("int"), "line").limit(most + 1)
    nth = rows.withColumn("k", F.row_number().over(Window.orderBy("id", (F.col("marker") == "__truncated__").cast("int"), "line")))
    last = F.col("k") > most
    return nth.select(F.when(last, "__truncated__").otherwise(F.col("id")).alias("id"), F.when(last, 0).otherwise(F.col("line")).alias("line"), F.when(last, "__truncated__").otherwise(F.col("marker")).alias("marker"))


def file_stale(pages: DataFrame) -> DataFrame:
    """Pages whose file (file_day) is younger than their date."""
    return issues(pages.where(F.col("file_day") > F.try_to_date("updated")), "frontmatter_stale", "info")


def run_all(pages: DataFrame, links: DataFrame, edges: DataFrame, as_of: str, sources: DataFrame | None = None, longest: int | None = None, slugs: bool = True) -> DataFrame:
    """The issues of all twelve checks: dead links, orphans, stubs, staleness by date, by file and of mature pages, drift of authors, metadata, uncited sources, cycles, slugs that look alike, callouts.

    pages are (id, type, title, content, source, created, updated, status, confidence, belief_state,
    authored_by) and file_day where it is known; sources are (ref).
    """
    from . import graph

    found = [dead_links(links, pages), orphans(pages, edges), stubs(pages), mature_stale(pages, as_of), authored_drift(pages)]
    old = stale(pages, as_of)
    found.append(old.select(F.lit("staleness").alias("check"), "severity", F.col("id").alias("page"), F.lit("").alias("target"), F.lit("").alias("message")))
    if "file_day" in pages.columns:
        found.append(file_stale(pages))
    wrong = pages.select("id", F.explode(frontmatter_errors()).alias("e"))
    found.append(issues(wrong, "frontmatter", "error", message=F.col("e")))
    if sources is not None:
        found.append(issues(source_coverage(sources.select("ref"), pages.select(F.col("source").alias("ref"))), "source_coverage", "warning", "ref"))
    circles = saved(graph.cycles(edges, longest), "cycles")  # a list of a hundred
    found.append(issues(circles.where("length > 0"), "cycle", "info", "path"))
    found.append(issues(circles.where("length = 0"), "cycle", "warning", "path", F.lit("there may be more cycles than are listed")))
    if slugs:
        found.append(issues(alike_slugs(pages.select("id")), "duplicate_slug", "warning", target=F.col("id2"), message=F.concat(F.lit("distance "), F.col("distance").cast("string"))))
    found.append(issues(callout_report(pages), "inline_callout", "info", message=F.concat("marker", F.lit(" at line "), F.col("line").cast("string"))))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def summary_lines(found: DataFrame, most: int = 1000) -> DataFrame:
    """(nth, line): a report of issues: totals by severity, counts by check, and the first `most` issues, errors first."""
    by = found.groupBy("severity").agg(F.count("*").alias("n")).select(F.lit(1).alias("part"), F.expr("CASE severity WHEN 'error' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END").alias("o"), F.concat(F.lit("- "), "severity", F.lit(": "), F.col("n").cast("string")).alias("line"))
    checks = found.groupBy("check").agg(F.count("*").alias("n")).select(F.lit(2).alias("part"), F.lit(0).alias("o"), F.concat(F.lit("- "), "check", F.lit(": "), F.col("n").cast("string"), F.lit(" issues")).alias("line"))
    rank = F.expr("CASE severity WHEN 'error' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END")
    text_ = F.concat_ws(" ", F.concat(F.lit("- ["), F.col("check"), F.lit("]")), "page", F.nullif(F.col("target"), F.lit("")), F.nullif(F.col("message"), F.lit("")))
    listed = found.select(F.lit(3).alias("part"), rank.alias("o"), text_.alias("line")).orderBy("o", "line").limit(most)
    lines = by.union(checks).union(listed)  # severities, checks and `most` issues
    return lines.withColumn("nth", F.row_number().over(Window.orderBy("part", "o", "line"))).select("nth", "line")


def rollup(found: DataFrame) -> DataFrame:
    """Issues by severity."""
    return found.groupBy("severity").agg(F.count("*").alias("n"))


def chunked(df: DataFrame, group: str, order: str, size: int = 5) -> DataFrame:
    """Rows of sorted groups in chunks; chunks of one row are left out."""
    over = Window.partitionBy(group)
    nth = F.row_number().over(over.orderBy(order)) - 1
    chunks = df.withColumn("chunk", F.floor(nth / size))
    return chunks.withColumn("__n", F.count("*").over(Window.partitionBy(group, "chunk"))).where("__n > 1").drop("__n")
