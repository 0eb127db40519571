"""Filling thin pages from the web: proposals, limits on fetching, states of a run, quality of what came in."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, text
from ..session import drop_path, drop_saved, saved, shared_dir, ship
from . import models

#: Fetches an hour in all, of a host, and of a run; largest page; characters of a text that relevance is judged by.
AN_HOUR, A_HOST, A_RUN, LARGEST, JUDGED = 60, 3, 10, 5 * 1024 * 1024, 2000
#: Calls of a piece of time that one task holds when limits are applied.
PIECE = 1 << 20
#: States that a gap goes through, states that it may end in at any time, and those from which a run is not resumed.
STEPS = ["pending", "proposed", "fetched", "saved", "extracted", "ingested", "verdict", "done"]
ENDS = ["abstained", "failed", "cooldown"]
COMPLETE = ["done", *ENDS]


def fetch_limited(calls: DataFrame, an_hour: int = AN_HOUR, a_host: int = A_HOST, a_run: int = A_RUN, seconds: int = 3600) -> DataFrame:
    """(entry, accepted, retry) of fetches (run, host, entry, at in seconds): limits of a run, of all hosts and of one host; retry is the seconds to wait.

    An answer depends on all answers before it, so calls are put in order of time and cut into pieces of
    about PIECE calls, which a task can hold. Pieces are gone through one after another only to find what
    is accepted: each takes on the accepted calls of the window before it, an_hour at most, and how many
    its runs have had. Then all pieces are answered side by side, as it is known what each begins with.
    """
    import uuid
    from collections import deque

    import pyarrow as pa
    import pyarrow.compute as pc

    spark = calls.sparkSession

    def through(batches, whole):
        """Each batch of (piece, earlier, at, run, host, allowed) with its answers and the window after it; earlier calls were accepted in a piece before.

        Unless it is to be whole, a batch of one piece is left without most calls that are surely rejected.
        """
        own, every, hosts, runs = None, deque(), {}, {}
        first = lambda h: every[0][0] if len(every) >= an_hour else hosts[h][0] if len(hosts.get(h, ())) >= a_host else None
        for batch in batches:
            if not whole:  # what is full when the batch begins stays so until its first call leaves the window
                of = batch.column(4).dictionary_encode(null_encoding="encode")
                since = pa.array([first(h) for h in of.dictionary.to_pylist()], pa.int64()).take(of.indices)
                batch = batch.filter(pc.or_(batch.column(1), pc.greater(pc.subtract(batch.column(2), since), seconds).fill_null(True)))
            ok, wait = [], []
            for piece, earlier, at, r, host, allowed in zip(*(batch.column(k).to_pylist() for k in range(6))):
                if piece != own:
                    own, every, hosts, runs = piece, deque(), {}, {}
                while every and every[0][0] < at - seconds:  # what leaves the window leaves its host too
                    h = every.popleft()[2]
                    hosts[h].popleft()
                    if not hosts[h]:
                        del hosts[h]
                full = None if earlier else first(host)
                spent = not earlier and runs.get(r, 0) >= allowed
                ok.append(not spent and full is None)
                wait.append(0 if spent or full is None else max(1, full + seconds - at + 1))
                if ok[-1]:
                    every.append((at, r, host))
                    hosts.setdefault(host, deque()).append(at)
                    if not earlier:
                        runs[r] = runs.get(r, 0) + 1
            here = pc.invert(batch.column(1))
            yield batch, here, pa.array(ok, pa.bool_()), pa.array(wait, pa.int64()), every

    def accepted(piece):
        def run(batches):
            """The accepted calls of the piece, and those that the next one begins with."""
            every = ()
            short = (batch.slice(k, 1024) for batch in batches for k in range(0, batch.num_rows, 1024))
            for batch, here, ok, _, every in through(short, False):
                rows = batch.select(range(5))
                found = rows.filter(pc.and_(here, ok))
                if found.num_rows:
                    yield found
            if every:
                columns = zip(*((piece + 1, True, *kept) for kept in every))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, rows.schema)], schema=rows.schema)

        return run

    def answered(batches):
        for batch, here, ok, wait, _ in through(batches, True):
            yield pa.RecordBatch.from_arrays([batch.column(6), ok, wait], names=["entry", "accepted", "retry"]).filter(here)

    def allowed(rows, known, hint):
        """rows with what their runs have left at the beginning of their piece, after known accepted calls."""
        had = known.where("NOT earlier").groupBy(F.col("run").alias("__run"), "piece").agg(F.count("*").alias("n"))
        had = had.groupBy("__run").agg(F.collect_list(F.struct("piece", "n")).alias("__had"))
        before = F.aggregate(F.filter("__had", lambda x: x["piece"] < F.col("piece")), F.lit(0).cast("long"), lambda n, x: n + x["n"])
        met = rows.join(had.hint(hint) if hint else had, F.col("run").eqNullSafe(F.col("__run")), "left")
        return met.withColumn("allowed", F.lit(a_run).cast("long") - F.coalesce(before, F.lit(0).cast("long"))).drop("__run", "__had")

    order = ["at", "entry", "run", "host"]
    ranges = max(1, -(-4 * calls.count() // PIECE))
    calls = calls.select("run", "host", "entry", "at").where("at IS NOT NULL")
    cut = saved(calls.repartitionByRange(ranges, *order).withColumn("range", F.spark_partition_id()), "calls")
    # a row for each quarter of a piece, whatever the number of calls
    piece_of, piece, held = {}, -1, PIECE
    for r in sorted(cut.groupBy("range").count().collect()):
        if held + r["count"] > PIECE:
            piece, held = piece + 1, 0
        piece_of[r["range"]] = piece
        held += r["count"]
    pieces = piece + 1
    shape = ", ".join(["piece int, earlier boolean", *(f"{c} {cut.schema[c].dataType.simpleString()}" for c in ("at", "run", "host"))])
    columns = ["piece", "earlier", "at", "run", "host", "allowed"]
    went = f"{shared_dir(spark)}/lodestar-accepted-{uuid.uuid4().hex}"
    cut.where("false").select(F.lit(0).alias("piece"), F.lit(False).alias("earlier"), "at", "run", "host").write.parquet(went)
    for piece in range(pieces):
        known = spark.read.schema(shape).parquet(went)
        here = cut.where(F.col("range").isin([r for r, p in piece_of.items() if p == piece])).withColumn("piece", F.lit(piece)).withColumn("earlier", F.lit(False))
        # not by broadcast, as what every round broadcasts goes through the driver
        here = allowed(here, known, "shuffle_hash").where("allowed > 0")
        begins = known.where(F.col("earlier") & (F.col("piece") == piece)).withColumn("entry", F.lit(None)).withColumn("allowed", F.lit(0))
        met = here.select(*columns, "entry").unionByName(begins)
        met.repartition(1).sortWithinPartitions("at", F.desc("earlier"), *order).select(*columns).mapInArrow(accepted(piece), shape).write.mode("append").parquet(went)
    known = spark.read.schema(shape).parquet(went)
    found = F.lit([piece_of.get(r, 0) for r in range(max(piece_of, default=0) + 1)])
    here = cut.withColumn("piece", F.get(found, F.col("range"))).withColumn("earlier", F.lit(False))
    begins = known.where(F.col("earlier") & (F.col("piece") < pieces)).withColumn("entry", F.lit(None)).withColumn("allowed", F.lit(0))
    met = allowed(here, known, None).select(*columns, "entry").unionByName(begins)
    kind = cut.schema["entry"].dataType.simpleString()
    out = saved(met.repartitionById(max(1, pieces), "piece").sortWithinPartitions("piece", "at", F.desc("earlier"), *order).mapInArrow(answered, f"entry {kind}, accepted boolean, retry long"), "answers")
    drop_path(spark, went)
    drop_saved(cut)
    return out


def advances(log: DataFrame) -> DataFrame:
    """The log (item, ts, state, nth) with `legal`: whether each transition is one step on, or an end, from a state that is no end."""
    from pyspark.sql import Window

    before = F.lag("state").over(Window.partitionBy("item").orderBy("ts", "nth"))
    place = lambda c: F.array_position(F.array(*map(F.lit, STEPS)), c)
    begins = before.isNull() & (F.col("state") == STEPS[0])
    legal = begins | (before.isNotNull() & ~before.isin(COMPLETE) & (F.col("state").isin(ENDS) | (place(F.col("state")) == place(before) + 1)))
    return log.withColumn("legal", F.coalesce(legal, F.lit(False)))


def incomplete(log: DataFrame) -> DataFrame:
    """(item, state) of the gaps that a run resumes with."""
    from .records import latest_state

    return latest_state(log).where(~F.col("state").isin(COMPLETE))


def run_summary(log: DataFrame) -> DataFrame:
    """One row for each run of a log (run, item, ts, state, nth): its gaps, by how they ended."""
    last = log.groupBy("run", "item").agg(F.max_by("state", F.struct("ts", "nth")).alias("state"))
    n = lambda s: F.sum((F.col("state") == s).cast("long"))
    return last.groupBy("run").agg(F.count("*").alias("examined"), n("done").alias("succeeded"), *[n(s).alias(s) for s in ENDS])


def wikipedia(page: Column, title: Column) -> Column:
    """The address of an entity's or concept's article, or null."""
    name = F.replace(text.small(F.trim(title)), F.lit(" "), F.lit("_"))
    fits = (F.startswith(page, F.lit("entities/")) | F.startswith(page, F.lit("concepts/"))) & (F.trim(title) != "")
    return F.when(fits, F.concat(F.lit("https://en.wikipedia.org/wiki/"), text.capital(F.substring(name, 1, 1)), F.regexp_replace(name, r"(?s)\A.", "")))


def stub(prompt: str) -> str:
    """A model that proposes nothing and finds everything half relevant."""
    return json.dumps({"action": "abstain", "reason": "no model", "score": 0.5})


def proposals(gaps: DataFrame, domains: list[str], model: Callable[[str], str] = stub, purpose: str = "") -> DataFrame:
    """gaps (id, type, title, sources) with action ("propose" or "abstain"), urls on the allowlist, and a reason."""
    listed = F.array_join(F.transform(F.slice(F.coalesce("sources", F.array().cast("array<string>")), 1, 10), lambda s: F.concat(F.lit("'"), F.substring(s, 1, 200), F.lit("'"))), ", ")
    prompt = F.concat(F.lit("Propose sources for '"), F.substring("title", 1, 100), F.lit("' ("), F.col("type"), F.lit("). It has: ["), listed, F.lit(f"]. Allowed: {', '.join(domains)}.\n"), text.wrapped_purpose(F.lit(purpose), 1000))
    asked = models.ask(gaps.withColumn("prompt", prompt), "prompt", model)
    r = asked.withColumn("r", F.from_json("reply", "action string, urls array<string>, reason string"))
    fine = F.filter(F.coalesce("r.urls", F.array().cast("array<string>")), lambda u: dates.allowed(u, domains))
    said = F.col("r.action")
    reason = F.when(said == "abstain", F.coalesce("r.reason", F.lit("abstained"))).when(F.coalesce(said != "propose", F.lit(True)), F.concat(F.lit("unexpected action: "), F.coalesce(said, F.lit("none")))).when(F.size(fine) == 0, "no allowlisted URLs in proposer response")
    return r.withColumn("urls", fine).withColumn("reason", reason).withColumn("action", F.when(F.col("reason").isNull(), "propose").otherwise("abstain")).withColumn("urls", F.when(F.col("action") == "propose", F.col("urls")).otherwise(F.array().cast("array<string>"))).drop("prompt", "reply", "r")


def relevance(rows: DataFrame, model: Callable[[str], str] = stub) -> DataFrame:
    """rows (title, content) with a score from 0 to 1; 0 where the model gives none."""
    prompt = F.concat(F.lit("Score how relevant the text is to '"), F.col("title"), F.lit("'.\n"), F.substring("content", 1, JUDGED))
    asked = models.ask(rows.withColumn("prompt", prompt), "prompt", model)
    score = F.try_to_number(F.get_json_object("reply", "$.score"), F.lit("9.999999")).cast("double")
    return asked.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(score, F.lit(0.0))))).drop("prompt", "reply")


def fetched(pages: DataFrame, domains: list[str]) -> DataFrame:
    """(url, status, content) of web pages (url, html) that are at hand, as a fetch would give them.

    Nothing is fetched here: scheme, domain, size and secrets are what is checked; scripts, styles
    and markup are taken out of what passes.
    """
    body = F.regexp_replace("html", r"(?is)<(script|style|noscript|template)\b.*?</\1\s*>|<!--.*?-->", " ")
    body = F.regexp_replace(F.regexp_replace(body, r"(?i)</(?:p|div|h[1-6]|li|tr|section|article)\s*>|<br\s*/?>", "\n"), r"<[^>]*>", "")
    body = F.regexp_replace(F.regexp_replace(body, r"[ \t]+", " "), r"\s*\n\s*", "\n")
    scheme = ~F.coalesce(F.col("url").rlike(r"(?i)^https?://"), F.lit(False))
    rows = pages.withColumn("content", F.regexp_replace(body, r"\A\s+|\s+\z", ""))
    secret = text.secret_label(text.without_code(F.col("content")))
    status = F.when(scheme, "blocked: scheme").when(~dates.allowed("url", domains), "blocked: domain").when(F.octet_length("html") > LARGEST, "blocked: size").when(F.coalesce(F.col("content"), F.lit("")) == "", "empty").when(secret.isNotNull(), F.concat(F.lit("blocked: "), secret)).otherwise("ok")
    return rows.withColumn("status", status).select("url", "status", F.when(F.col("status") == "ok", F.col("content")).alias("content"))


def quality(pages: DataFrame) -> DataFrame:
    """(id, verdict, reason) of pages after they were filled: a page that is still thin, or has no source, fails."""
    reason = F.when(F.char_length(F.trim("content")) < 100, "still a stub").when(F.coalesce(F.trim("source"), F.lit("")) == "", "no source")
    return pages.select("id", F.when(reason.isNull(), "pass").otherwise("fail").alias("verdict"), reason.alias("reason"))


#: The lines of a proposal file, by what they hold.
HEAD, TITLE, ACTION, URLS = r"##\s+\d+\.\s+(.+?)\s*", r"-\s+\*\*Title:\*\*\s+(.+?)\s*", r"-\s+\*\*Action:\*\*\s+(.+?)\s*", "- **URLs:**"
URL, RATIONALE, REASON = r"\s{2}-\s+(\S+)\s*", r"-\s+\*\*Rationale:\*\*\s*(.*?)\s*", r"-\s+\*\*Reason:\*\*\s*(.*?)\s*"
PROPOSAL = "id string, title string, action string, urls array<string>, rationale string, reason string"


def proposal_text(nth: Column) -> Column:
    """A proposal (id, title, action, urls, reason), and rationale if there is such a column's value, as a section of a proposal file; line breaks in a field become spaces."""
    line = lambda name, c: F.concat(F.lit(f"- **{name}:** "), F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"\R", " "), F.lit("\n"))
    urls = F.array_join(F.transform("urls", lambda u: F.concat(F.lit("  - "), u, F.lit("\n"))), "")
    told = F.when(F.col("action") == "propose", F.concat(F.lit(f"{URLS}\n"), urls, line("Rationale", "reason"))).otherwise(line("Reason", "reason"))
    return F.concat(F.lit("## "), nth.cast("string"), F.lit(". "), F.col("id"), F.lit("\n"), line("Title", "title"), line("Action", "action"), told)


def proposal_files(rows: DataFrame, at: str) -> DataFrame:
    """(run, text): the proposal file of each run, from rows (run, nth, and a proposal's columns); a run has few proposals by its own limit."""
    one = rows.select("run", F.struct("nth", proposal_text(F.col("nth")).alias("s")).alias("p"))
    head = F.concat(F.lit("# Augment Proposals - run `"), F.substring("run", 1, 8), F.lit(f"`\nGenerated: {at}\n\nReview each proposal below; run `kb lint --augment --execute` to fetch + save to `raw/`.\n\n"))
    return one.groupBy("run").agg(F.array_sort(F.collect_list("p")).alias("p")).select("run", F.concat(head, F.array_join("p.s", "\n")).alias("text"))


class _Proposals:
    """Rows of one proposal file: a table function, since a field's meaning depends on the lines before it."""

    def eval(self, text: str):
        import re

        fields = [("title", re.compile(TITLE)), ("action", re.compile(ACTION)), ("rationale", re.compile(RATIONALE)), ("reason", re.compile(REASON))]
        head, url = re.compile(HEAD), re.compile(URL)
        found, listing = None, False
        for line in [*(text or "").splitlines(), None]:
            opens = line is not None and head.fullmatch(line)
            if line is None or opens:
                if found and "title" in found and "action" in found and (found["action"] != "propose" or found["urls"]):
                    yield tuple(found.get(c) for c in ("id", "title", "action", "urls", "rationale", "reason"))
                found, listing = {"id": opens[1].strip(), "urls": []} if opens else None, False
            elif found is not None:
                if listing and (one := url.fullmatch(line)):
                    found["urls"].append(one[1])
                    continue
                listing = line.strip() == URLS
                for name, form in fields:
                    if one := form.fullmatch(line):
                        found[name] = one[1].strip()
                        break


def proposals_of(texts: DataFrame, c: str = "text") -> DataFrame:
    """The columns of texts and those of PROPOSAL, a row for each section of a proposal file.

    A section without a title or an action, or that proposes without an URL, is left out; lines of no known
    form are passed over, and end a list of URLs. The last of several lines of one field counts. A null
    text has no rows.
    """
    ship(texts.sparkSession)
    parse = F.udtf(_Proposals, returnType=PROPOSAL)
    return texts.lateralJoin(parse(F.col(c).outer()))
