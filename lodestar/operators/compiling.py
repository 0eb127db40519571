"""Compile as one operation: which sources, their states in the manifest, their pages, what is pruned, what is built anew.

Manifest and pages are versioned tables below one path. A run marks its sources as in progress, has
them taken in, swaps the pages, then swaps the manifest with what came out. Wherever it dies, every
reader finds whole tables, and the next run finds the sources it had begun, says so, and does them
again; pages are put in place by id, so doing them twice changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import drop_path, drop_saved, saved
from ..sources import writers
from ..sources.versions import Versioned
from . import vectors

#: States in a manifest, and keys of templates in it.
BEGUN, FAILED, TEMPLATE = "in_progress:", "failed:", "_template/"
MANIFEST = "key string, value string"
PAGES = "id string, type string, title string, content string, sources array<string>"


@dataclass
class Report:
    """What a run did. stale: sources that an earlier run had begun and not ended; a bounded part of the frames' sizes only."""

    mode: str
    processed: int = 0
    created: int = 0
    updated: int = 0
    duplicates: int = 0
    errors: int = 0
    stale: int = 0
    pruned: int = 0

    def line(self) -> str:
        return f"{self.mode} compile: {self.processed} sources, {self.created} pages created, {self.updated} pages updated, {self.duplicates} duplicate(s), {self.errors} errors"


def stale(manifest: DataFrame) -> DataFrame:
    """(key): sources that a run began and never ended."""
    return manifest.where(F.startswith("value", F.lit(BEGUN))).select("key")


def to_process(manifest: DataFrame, sources: DataFrame, templates: DataFrame | None = None, full: bool = False) -> DataFrame:
    """The sources (ref, kind, hash, ...) that a run takes in: all, or those new, changed, failed, begun before, or of a kind whose template changed.

    templates: (kind, hash). A kind whose template the manifest has never seen counts as unchanged, as
    on a first run.
    """
    if full:
        return sources
    known = manifest.where(~F.startswith("key", F.lit(TEMPLATE))).select(F.col("key").alias("__k"), F.col("value").alias("__v"))
    met = sources.join(known, F.col("ref") == F.col("__k"), "left")
    todo = F.col("__v").isNull() | (F.col("__v") != F.col("hash"))
    if templates is not None:
        old = manifest.select(F.col("key").alias("__t"), F.col("value").alias("__h"))
        moved = templates.join(old, F.concat(F.lit(TEMPLATE), "kind") == F.col("__t")).where(F.col("hash") != F.col("__h")).select(F.col("kind").alias("__kind")).distinct()
        met = met.join(moved, F.col("kind") == F.col("__kind"), "left")
        todo = todo | F.col("__kind").isNotNull()
    return met.where(todo).select(*sources.columns)


def told_apart(todo: DataFrame, manifest: DataFrame) -> DataFrame:
    """todo with duplicate: its content is that of another source that is done, or of one in todo whose name comes first."""
    done = manifest.where(~F.startswith("key", F.lit(TEMPLATE))).select(F.col("key").alias("__k"), F.col("value").alias("__h"))
    first = todo.groupBy(F.col("hash").alias("__h")).agg(F.min("ref").alias("__first"))
    # of the finished sources of a content the smallest name but the source's own: two are enough
    held = done.groupBy("__h").agg(F.min("__k").alias("__one"), F.max("__k").alias("__two"))
    known = first.join(held, "__h", "left")
    met = todo.join(known.hint("rebalance"), F.col("hash") == F.col("__h"))
    other = (F.col("__one").isNotNull() & (F.col("__one") != F.col("ref"))) | (F.col("__two").isNotNull() & (F.col("__two") != F.col("ref")))
    return met.withColumn("duplicate", other | (F.col("__first") != F.col("ref"))).select(*todo.columns, "duplicate")


def begun(manifest: DataFrame, todo: DataFrame) -> DataFrame:
    """The manifest as a run begins."""
    come = todo.select(F.col("ref").alias("key"), F.concat(F.lit(BEGUN), F.col("hash")).alias("value"))
    return manifest.join(come.select("key"), "key", "left_anti").unionByName(come)


def ended(manifest: DataFrame, outcomes: DataFrame, templates: DataFrame | None = None) -> DataFrame:
    """The manifest as a run ends: hashes, or failed: and the hash, of its sources (ref, hash, ok), and the templates' own."""
    done = outcomes.select(F.col("ref").alias("key"), F.when(F.col("ok"), F.col("hash")).otherwise(F.concat(F.lit(FAILED), F.col("hash"))).alias("value"))
    if templates is not None:
        done = done.unionByName(templates.select(F.concat(F.lit(TEMPLATE), "kind").alias("key"), F.col("hash").alias("value")))
    return manifest.join(done.select("key"), "key", "left_anti").unionByName(done)


def pruned(manifest: DataFrame, sources: DataFrame) -> DataFrame:
    """The manifest without keys of sources that are gone. Templates stay, and so do sources that are marked as begun: a person is to look at those."""
    there = sources.select(F.col("ref").alias("key"))
    special = F.startswith("key", F.lit(TEMPLATE)) | F.startswith("value", F.lit(BEGUN))
    return manifest.where(special).unionByName(manifest.where(~special).join(there, "key", "left_semi"))


def merged(pages: DataFrame, made: DataFrame) -> DataFrame:
    """pages with the pages that sources made (ref, id, type, title, content) in their place; of several for one id the one of the first source, and the sources of all."""
    new = made.groupBy("id").agg(F.min_by(F.struct("type", "title", "content"), "ref").alias("p"), F.array_sort(F.collect_set("ref")).alias("own")).select("id", "p.*", "own")
    old = pages.select(F.col("id").alias("__id"), F.col("sources").alias("__had"), *[F.col(c).alias(f"__{c}") for c in ("type", "title", "content")])
    both = old.join(new, F.col("__id") == F.col("id"), "full_outer")
    fields = [F.when(F.col("id").isNull(), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) for c in ("type", "title", "content")]
    none = F.array().cast("array<string>")
    return both.select(F.coalesce("id", "__id").alias("id"), *fields, F.array_sort(F.array_union(F.coalesce("__had", none), F.coalesce("own", none))).alias("sources"))


class Compiler:
    """Manifest, pages, indexes and log below one path."""

    def __init__(self, spark: SparkSession, path: str, step=lambda name: None):
        self.spark, self.path = spark, path.rstrip("/")
        self.manifest_table = Versioned(spark, f"{self.path}/manifest", step=lambda n: step(f"manifest {n}"))
        self.pages_table = Versioned(spark, f"{self.path}/pages", step=lambda n: step(f"pages {n}"))
        self.step = step

    def manifest(self) -> DataFrame:
        found = self.manifest_table.read()
        return self.spark.createDataFrame([], MANIFEST) if found is None else found

    def pages(self) -> DataFrame:
        found = self.pages_table.read()
        return self.spark.createDataFrame([], PAGES) if found is None else found

    def compile(self, sources: DataFrame, ingest: Callable[[DataFrame], DataFrame], full: bool = False, templates: DataFrame | None = None, batch: int | None = None, now: str | None = None) -> Report:
        """Take in sources (ref, kind, hash, ...), by ingest: sources to (ref, ok, error, pages), pages an array of (id, type, title, content).

        A source that ingest gives no row for has failed. With batch, a number that grows, a batch that is in
        the manifest already does nothing. full takes in all sources and prunes the manifest. With now, a
        timestamp, a line goes to the log.
        """
        report = Report("full" if full else "incremental")
        head = self.manifest_table.head()
        if batch is not None and head is not None and head["batch"] is not None and head["batch"] >= batch:
            return report
        known = self.manifest()
        report.stale = stale(known).count()
        todo = saved(told_apart(to_process(known, sources, templates, full), known), "todo")
        report.processed = todo.count()
        outcomes = None
        if report.processed:
            self.manifest_table.replace(begun(known, todo))
            self.step("begun")
            fresh = todo.where("NOT duplicate").drop("duplicate")
            got = ingest(fresh).select(F.col("ref").alias("__ref"), "ok", "error", "pages")
            outcomes = todo.join(got, F.col("ref") == F.col("__ref"), "left").select("ref", "hash", "duplicate", F.coalesce(F.col("duplicate") | F.col("ok"), F.lit(False)).alias("ok"), "error", "pages")
            outcomes = saved(outcomes, "outcomes")
            self.step("taken in")
            counts = outcomes.agg(F.sum((~F.col("ok")).cast("long")), F.sum(F.col("duplicate").cast("long"))).first()
            report.errors, report.duplicates = counts[0], counts[1]
            made = outcomes.where("ok AND NOT duplicate").select("ref", F.explode("pages").alias("p")).select("ref", "p.*")
            had = self.pages()
            ids = made.select("id").distinct()
            report.updated = ids.join(had.select("id"), "id", "left_semi").count()
            report.created = ids.count() - report.updated
            self.pages_table.replace(merged(had, made))
            self.step("pages")
        after = self.manifest()
        if outcomes is not None:
            after = ended(after, outcomes, templates)
        elif templates is not None:
            after = ended(after, self.spark.createDataFrame([], "ref string, hash string, ok boolean"), templates)
        if full:
            before = after.count()
            after = pruned(after, sources)
            report.pruned = before - after.count()
        self.manifest_table.replace(after, batch)
        drop_saved(todo)
        if outcomes is not None:
            drop_saved(outcomes)
        if now is not None:
            self._log(now, "compile", report.line())
        return report

    def _log(self, now: str, op: str, message: str) -> None:
        line = self.spark.range(1).select(F.lit(now).cast("timestamp").alias("ts"), F.lit(op).alias("op"), F.lit(message).alias("message"))
        writers.append_log(line, f"{self.path}/log")
        writers.rotate_log(self.spark, f"{self.path}/log", now[:7])

    def rebuild(self, now: str, build: bool = True, dim: int = vectors.DIM) -> dict[str, str]:
        """Wipe what is derived (manifest, search index, vector index, caches), build the indexes anew from the pages, and log it; "cleared", or an error, by part.

        Without build, the next compile and the next question find nothing and begin afresh. One part that
        cannot be wiped does not keep the others.
        """
        result = {}
        for part in ("manifest", "search", "vectors"):
            try:
                drop_path(self.spark, f"{self.path}/{part}")
                result[part] = "cleared"
            except Exception as e:  # noqa: BLE001  any store's own error; it is reported
                result[part] = str(e)[:500] or "unknown"
        self.spark.catalog.clearCache()
        if build and self.pages_table.head() is not None:
            from . import retrieval

            pages = self.pages()
            retrieval.write_index(pages, f"{self.path}/search")
            vectors.VectorIndex(self.spark, f"{self.path}/vectors").build(vectors.embedded(pages, dim))
        self._log(now, "rebuild-indexes", " ".join(f"{k}={v}" for k, v in result.items()) + " caches_cleared=1")
        return result
