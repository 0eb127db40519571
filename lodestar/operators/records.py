"""Drift of sources, trust, verdicts, gaps, connections and contradictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, text

#: Trust from which a page is flagged, change of a pass rate that is a trend, least verdicts of a period.
LOW_TRUST, TREND, LEAST = 0.4, 0.1, 3
#: Words that turn a statement round.
SIGNALS = ["not", "never", "no longer", "instead", "rather than", "unlike", "contrary", "wrong", "incorrect", "false", "replaced", "deprecated", "obsolete", "outdated"]
SIGNAL = rf"(?i)(^|[^\p{{L}}\p{{N}}_])(?:{'|'.join(SIGNALS)})([^\p{{L}}\p{{N}}_]|$)"


#: Tokens of claims that every task may hold.
CLAIMED = 1 << 17


def drift(manifest: DataFrame, sources: DataFrame) -> DataFrame:
    """(ref, state) of sources that are new, changed or deleted against what was known."""
    both = manifest.join(sources, F.col("key") == F.col("ref"), "full_outer")
    state = F.when(F.col("key").isNull(), "new").when(F.col("ref").isNull(), "deleted").when(F.startswith("value", F.lit("failed:")), "changed").when(F.startswith("value", F.lit("in_progress:")), "changed").when(F.col("value") != F.col("hash"), "changed")
    return both.select(F.coalesce("ref", "key").alias("ref"), state.alias("state")).where("state IS NOT NULL")


def affected(changes: DataFrame, pages: DataFrame) -> DataFrame:
    """(id, refs): pages that cite changed or deleted sources."""
    hit = pages.join(changes.where("state <> 'new'").select(F.col("ref").alias("r")), F.col("ref") == F.col("r"))
    return hit.groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("r")), ",").alias("refs"))


def page_trust(feedback: DataFrame) -> DataFrame:
    """Counts of ratings and trust (4 places) of each page."""
    n = lambda r: F.sum((F.col("rating") == r).cast("long"))
    sums = feedback.groupBy("page").agg(n("useful").alias("useful"), n("wrong").alias("wrong"), n("incomplete").alias("incomplete"), F.max("ts").alias("last"))
    return sums.withColumn("trust", F.bround(dates.trust("useful", "wrong", "incomplete"), 4))


def weekly(verdicts: DataFrame) -> DataFrame:
    """Verdicts of each week; unknown ones count in the total only."""
    n = lambda v: F.sum((F.col("verdict") == v).cast("long"))
    w = verdicts.groupBy(F.date_trunc("week", "ts").alias("week")).agg(n("pass").alias("passed"), n("fail").alias("failed"), n("warning").alias("warned"), F.count("*").alias("total"))
    return w.withColumn("rate", F.round(F.col("passed") / F.col("total"), 2))


def trend(weeks: DataFrame) -> DataFrame:
    """One row: how the last week's pass rate stands to the one before."""
    last = weeks.orderBy(F.desc("week")).limit(2)  # two rows
    both = last.select("*", F.row_number().over(Window.orderBy(F.desc("week"))).alias("k")).groupBy().agg(*[F.max(F.when(F.col("k") == k, F.col(c))).alias(f"{c}{k}") for k in (1, 2) for c in ("rate", "total")])
    change = F.round(F.col("rate1") - F.col("rate2"), 4)
    state = F.when((F.coalesce("total1", F.lit(0)) < LEAST) | (F.coalesce("total2", F.lit(0)) < LEAST), "stable").when(change > TREND, "improving").when(change < -TREND, "declining").otherwise("stable")
    return both.select(state.alias("trend"), change.alias("change"))


def gaps(feedback: DataFrame) -> DataFrame:
    """One incomplete answer for each question: longest notes, then latest, then first."""
    best = F.max_by(F.struct("entry", "page"), F.struct(F.char_length("notes"), "ts", -F.col("entry"))).alias("best")
    return feedback.where("rating = 'incomplete' AND question <> ''").groupBy("question").agg(best).select("question", "best.entry", "best.page")


def connections(pages: DataFrame, links: DataFrame, low: int = 2, high: int = 5, least: int = 3) -> DataFrame:
    """(a, b, shared): pages that share rare terms and are not linked. A term has `high` pages at most, so its pairs are few."""
    t = pages.select("id", F.explode(text.connection_terms("content")).alias("term"))
    counts = t.groupBy("term").agg(F.count("*").alias("df")).where(f"df BETWEEN {low} AND {high}").withColumnRenamed("term", "k")
    few = t.join(counts, F.col("term") == F.col("k"), "left_semi")
    ids = few.groupBy("term").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    pairs = ids.select(F.explode(F.expr("flatten(transform(ids, (x, i) -> transform(slice(ids, i + 2, size(ids)), y -> named_struct('a', x, 'b', y))))")).alias("p"))
    shared = pairs.groupBy("p.a", "p.b").agg(F.count("*").alias("shared")).where(F.col("shared") >= least)
    linked = links.select(F.least("src", "dst").alias("x"), F.greatest("src", "dst").alias("y")).distinct()
    return shared.join(linked, (F.col("a") == F.col("x")) & (F.col("b") == F.col("y")), "left_anti")


def sentences(df: DataFrame, c: str) -> DataFrame:
    """One row for each sentence of c, as (nth, sentence) beside the other columns."""
    return df.select("*", F.posexplode(F.split(F.col(c), r"(?<=[.!?])\s+")).alias("nth", "sentence")).withColumn("sentence", F.trim("sentence")).where("sentence <> ''")


def contradictions(claims: DataFrame, pages: DataFrame, overlap: int = 2, most: int = 5) -> DataFrame:
    """(claim, part, id, nth): for each sentence of a claim and each page, the first of the page's first `most` sentences that share tokens with it, of which just one side is negated.

    claims has few rows by contract (claim, text): up to CLAIMED tokens of theirs go to every task, and a
    page's sentences are counted where they are read, without a shuffle. Of more, or where ids repeat,
    tokens meet the pages' in an equal join.
    """
    parts = sentences(claims.select("claim", "text"), "text").select("claim", F.col("nth").alias("part"), F.col("sentence").rlike(SIGNAL).alias("no"), text.significant("sentence").alias("terms"))
    c = parts.where(F.size("terms") >= 2).select("claim", "part", "no", F.explode("terms").alias("term"))
    few = c.limit(CLAIMED + 1).toArrow().combine_chunks()
    if few.num_rows <= CLAIMED and claims.groupBy("claim").count().where("count > 1 OR claim IS NULL").isEmpty():
        return _met_in_place(few, claims.schema['claim'].dataType.simpleString(), pages, overlap, most)
    s = sentences(pages.select("id", text.unmarked("content").alias("content")), "content").select("id", "nth", F.col("sentence").rlike(SIGNAL).alias("has"), F.explode(text.significant("sentence")).alias("t"))
    met = s.join(c, F.col("t") == F.col("term")).groupBy("claim", "part", "id", "nth", "no", "has").agg(F.count("*").alias("n")).where(F.col("n") >= overlap)
    # at most as many candidates as sentences of a page stand in a group
    first = met.withColumn("k", F.row_number().over(Window.partitionBy("claim", "part", "id").orderBy("nth"))).where(F.col("k") <= most)
    return first.where(F.col("no") != F.col("has")).groupBy("claim", "part", "id").agg(F.min("nth").alias("nth"))


def _met_in_place(claimed, kind: str, pages: DataFrame, overlap: int, most: int) -> DataFrame:
    """contradictions() with the tokens of all claims (claim, part, no, term), an Arrow table, in every task."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    terms = claimed.column("term").combine_chunks().dictionary_encode() if claimed.num_rows else pa.array([], pa.string()).dictionary_encode()
    heads = claimed.select(["claim", "part", "no"]).group_by(["claim", "part", "no"], use_threads=False).aggregate([])
    of = {k: i for i, k in enumerate(zip(*(heads.column(c).to_pylist() for c in ("claim", "part"))))}
    owner = np.array([of[k] for k in zip(*(claimed.column(c).to_pylist() for c in ("claim", "part")))], np.int64)
    code = terms.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    owner = owner[np.argsort(code, kind="stable")]
    known, n, size = terms.dictionary, len(of), np.bincount(code, minlength=len(terms.dictionary))
    begin = np.cumsum(size) - size
    no = np.array(heads.column("no").to_pylist(), bool)
    claim, part = heads.column("claim").combine_chunks(), heads.column("part").combine_chunks()

    def run(batches):
        for batch in batches:
            told = batch.column(1)
            has, lists = told.flatten().flatten()
            page = np.repeat(np.arange(batch.num_rows), pc.list_value_length(told).to_numpy(zero_copy_only=False).astype(np.int64))
            first = np.concatenate([[0], np.cumsum(np.bincount(page, minlength=batch.num_rows))])
            word = pc.fill_null(pc.index_in(lists.flatten(), value_set=known), -1).to_numpy(zero_copy_only=False)
            at = np.repeat(np.arange(len(page)), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))
            at, word = at[word >= 0], word[word >= 0]
            pairs, step = [np.zeros(0, np.int64)], max(1, (1 << 22) // max(n, 1))
            for a in range(0, len(page), step):
                lo, hi = np.searchsorted(at, [a, a + step])
                w = word[lo:hi]
                k = size[w]
                own = owner[np.repeat(begin[w] - np.cumsum(k) + k, k) + np.arange(k.sum())]
                shared = np.bincount(np.repeat(at[lo:hi] - a, k) * n + own, minlength=1)
                pairs.append(np.flatnonzero(shared >= overlap) + a * n)
            found = np.concatenate(pairs)
            at, own = found // max(n, 1), found % max(n, 1)
            group = page[at] * n + own
            order = np.argsort(group, kind="stable")
            at, own, group = at[order], own[order], group[order]
            new = np.append(True, group[1:] != group[:-1])[: len(group)]
            nth = np.arange(len(group)) - np.maximum.accumulate(np.where(new, np.arange(len(group)), 0))
            keep = (nth < most) & (has.to_numpy(zero_copy_only=False)[at] != no[own])
            at, own, group = at[keep], own[keep], group[keep]
            one = np.append(True, group[1:] != group[:-1])[: len(group)]
            at, own = at[one], pa.array(own[one])
            yield pa.RecordBatch.from_arrays([claim.take(own), part.take(own), batch.column(0).take(pa.array(page[at])), pa.array((at - first[page[at]]).astype(np.int32))], names=["claim", "part", "id", "nth"])

    cut = F.transform(F.split(text.unmarked("content"), r"(?<=[.!?])\s+"), F.trim)
    told = F.transform(cut, lambda x: F.struct(x.rlike(SIGNAL).alias("has"), text.significant(x).alias("terms")))
    return pages.select("id", F.coalesce(told, F.array().cast("array<struct<has:boolean,terms:array<string>>>")).alias("told")).mapInArrow(run, f"claim {kind}, part int, id {pages.schema['id'].dataType.simpleString()}, nth int")


def failing(verdicts: DataFrame) -> DataFrame:
    """(page) of pages with a failed check, each once."""
    return verdicts.where("verdict = 'fail'").select("page").distinct()


def newest(df: DataFrame, by: str, keep: int, tie: str) -> DataFrame:
    """The newest `keep` rows of a log."""
    return df.orderBy(F.desc(by), F.desc(tie)).limit(keep)


def swept(reviews: DataFrame, now: str, hours: int = 168, delete: bool = False) -> DataFrame:
    """Reviews (status, attempt_id, ts, ...) after a sweep: pending ones older than `hours` are marked failed, or left out; rows without an attempt stay."""
    old = F.col("ts") < F.lit(now).cast("timestamp") - F.make_interval(hours=F.lit(hours))
    stale = F.coalesce((F.col("status") == "pending") & old & (F.coalesce("attempt_id", F.lit("")) != ""), F.lit(False))
    return reviews.where(~stale) if delete else reviews.withColumn("status", F.when(stale, "failed").otherwise(F.col("status")))


def begun(manifest: DataFrame, sources: DataFrame) -> DataFrame:
    """The manifest (key, value) as a compile run begins: sources (ref, hash) to come are in progress."""
    come = sources.select(F.col("ref").alias("key"), F.concat(F.lit("in_progress:"), F.col("hash")).alias("value"))
    return manifest.join(come.select("key"), "key", "left_anti").unionByName(come)


def ended(manifest: DataFrame, outcomes: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """The manifest after a run: sources (ref, hash, ok) have their hash, or failed: and their hash. With existing (ref), a full run, keys of sources that are gone go."""
    done = outcomes.select(F.col("ref").alias("key"), F.when(F.col("ok"), F.col("hash")).otherwise(F.concat(F.lit("failed:"), F.col("hash"))).alias("value"))
    new = manifest.join(done.select("key"), "key", "left_anti").unionByName(done)
    return new if existing is None else new.join(existing.select(F.col("ref").alias("key")), "key", "left_semi")


def latest_state(log: DataFrame) -> DataFrame:
    """(item, state): the last state of each item in an append-only log (item, ts, state, nth)."""
    return log.groupBy("item").agg(F.max_by("state", F.struct("ts", "nth")).alias("state"))


def segments(calls: DataFrame, seconds: int, by: list[str]) -> DataFrame:
    """calls with segment: a number that changes, within the columns of by, wherever no call came for longer than `seconds`.

    After such a gap nothing of a sliding window is left, so segments can be gone through apart. There are
    no such gaps inside a stretch of `seconds`, so only each stretch's first and last call are compared.
    """
    bins = calls.groupBy(*[F.col(c).alias(f"__{c}") for c in by], F.floor(F.col("at") / seconds).alias("__bin")).agg(F.min("at").alias("__lo"), F.max("at").alias("__hi"))
    # a row for each stretch of time, whatever the number of calls
    order = Window.partitionBy(*[f"__{c}" for c in by]).orderBy("__bin")
    begins = F.coalesce(F.col("__lo") - F.lag("__hi").over(order) > seconds, F.lit(True))
    bins = bins.withColumn("__new", begins).withColumn("segment", F.last(F.when(F.col("__new"), F.col("__bin")), ignorenulls=True).over(order)).drop("__new", "__lo", "__hi")
    on = F.floor(F.col("at") / seconds) == F.col("__bin")
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return calls.join(bins.hint("rebalance"), on).drop("__bin", *[f"__{c}" for c in by])


def limited(calls: DataFrame, cap: int, seconds: int = 3600, by: list[str] | None = None) -> DataFrame:
    """(entry, accepted) of calls (key, entry, at in seconds): at most cap accepted calls of a key in a sliding window; rejected calls are not counted.

    With by, other columns stand for the key; none, and the limit is one for all calls. The rule depends
    on earlier answers, so the calls of a segment (see segments) are gone through in order of time. They
    stream by in batches; what is kept is the accepted calls of one window, cap at most.
    """
    from collections import deque

    import pyarrow as pa

    by = ["key"] if by is None else by

    def run(batches):
        key, live = None, deque()
        for batch in batches:
            out = []
            *keys, entries, times = batch.columns
            for at, *k in zip(times.to_pylist(), *(c.to_pylist() for c in keys)):
                if k != key:
                    key, live = k, deque()
                while live and live[0] < at - seconds:
                    live.popleft()
                out.append(len(live) < cap)
                if out[-1]:
                    live.append(at)
            yield pa.RecordBatch.from_arrays([entries, pa.array(out, pa.bool_())], names=["entry", "accepted"])

    cut = segments(calls.select(*by, "entry", "at"), seconds, by).select(*by, "segment", "entry", "at")
    return cut.repartition(*by, "segment").sortWithinPartitions(*by, "segment", "at", "entry").mapInArrow(run, f"entry {calls.schema['entry'].dataType.simpleString()}, accepted boolean")
