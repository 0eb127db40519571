"""Line dedup by levelled sorted runs of line hashes.

A run is a table of keys (two 64-bit hashes of a folded line) and the number of documents that hold
each, bucketed and sorted by key. There are two kinds: settled runs, of keys known to be common, and
counting runs, of the others. A new batch of documents counts its keys, merge-anti-joins the settled
runs, since what is common already needs no more counting, and adds the rest as a counting run of
level 0. Whenever a level holds FANOUT runs they are merged into one of the next level; keys that
have reached the least number move to a settled run. Runs are bucketed as batches are dealt, so a
batch meets the settled runs in place; a merge shuffles the keys of the runs that it merges.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, attach, drop_path, drop_written, only, shared_dir, without, written

#: Runs of a level that are merged into one of the next.
FANOUT = 4
#: Batches of a table that is taken in at once.
BATCHES = 8
#: Fixed value: what is stripped from the ends of a line.
SPACE = " \t\n\x0b\x0c\r"
KEY = ["h1", "h2"]
RUN = "h1 long, h2 long, n long"
OUTPUT = ["n_lines", "n_dropped", "kept_sha256", "kept_text"]


def key_of(line):
    return F.translate(F.btrim(line, F.lit(SPACE)), UPPER, LOWER)


def hashes(key):
    """128 bits of a key."""
    return F.struct(F.xxhash64(F.lit(11), key).alias("h1"), F.xxhash64(F.lit(97), key).alias("h2"))


class LineRuns:
    """Counts of the documents of every key, over batches that come one after another."""

    def __init__(self, spark: SparkSession, least: int, buckets: int | None = None, fanout: int = FANOUT):
        self.spark, self.least, self.fanout = spark, least, fanout
        # as a batch's own exchange deals its keys, so that it meets and becomes runs without another
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.at = f"{shared_dir(spark)}/lodestar-runs-{uuid.uuid4().hex}"
        self.levels: list[list[str]] = []
        self.settled: list[list[str]] = []

    def _write(self, run: DataFrame) -> str:
        name = f"lodestar_run_{uuid.uuid4().hex}"
        run.select(*KEY, "n").write.format("parquet").bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", f"{self.at}/{name}").saveAsTable(name)
        return name

    def _read(self, names: list[str]) -> DataFrame:
        """The runs of names one after another; keys may repeat between them."""
        if not names:
            return self.spark.createDataFrame([], RUN)
        # by path, since Spark 4.1.2 takes a union of bucketed tables for bucketed too, and then sums each on its own
        return self.spark.read.schema(RUN).parquet(*[f"{self.at}/{n}" for n in names])

    def _drop(self, names: list[str]) -> None:
        for n in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {n}")
            drop_path(self.spark, f"{self.at}/{n}")

    def _push(self, levels: list[list[str]], run: DataFrame, level: int = 0) -> None:
        while len(levels) <= level:
            levels.append([])
        levels[level].append(self._write(run))

    def add(self, keys: DataFrame) -> None:
        """A batch of keys (h1, h2), a row for each document that holds a key."""
        batch = keys.groupBy(*KEY).agg(F.count("*").alias("n"))
        for run in [n for level in self.settled for n in level]:
            # Spark would push an anti join under the aggregate, where a hot key still has all its rows
            known = self.spark.table(run).select(*KEY, F.lit(True).alias("known")).hint("merge")
            batch = batch.join(known, KEY, "left").where("known IS NULL").drop("known")
        self._push(self.levels, batch)
        self._compact()

    def _merged(self, names: list[str]) -> DataFrame:
        """Counts of several runs."""
        return self._read(names).groupBy(*KEY).agg(F.sum("n").alias("n"))

    def _merge(self, level: int) -> None:
        """One run of the next level out of a level's runs; what has become common is settled."""
        names = self.levels[level]
        both = written(self._merged(names), "merged")
        self.levels[level] = []
        # a key that was settled after it was counted in an older run stays in both kinds until here; it is common either way
        self._push(self.settled, both.where(F.col("n") >= self.least))
        self._push(self.levels, both.where(F.col("n") < self.least), level + 1)
        drop_written(both)
        self._drop(names)
        for k in range(len(self.settled)):
            if len(self.settled[k]) >= self.fanout:
                runs, self.settled[k] = self.settled[k], []
                self._push(self.settled, self._read(runs).groupBy(*KEY).agg(F.max("n").alias("n")), k + 1)
                self._drop(runs)

    def _compact(self) -> None:
        level = 0
        while level < len(self.levels):
            if len(self.levels[level]) >= self.fanout:
                self._merge(level)
            level += 1

    def common(self) -> DataFrame:
        """(h1, h2), once each: the keys in at least so many documents, as a table of its own."""
        counting = [n for level in self.levels for n in level]
        found = self._read([n for level in self.settled for n in level]).select(*KEY)
        if counting:
            found = found.unionByName(self._merged(counting).where(F.col("n") >= self.least).select(*KEY))
        return written(found.distinct(), "common")

    def drop(self) -> None:
        """Delete the runs."""
        self._drop([n for kind in (self.levels, self.settled) for level in kind for n in level])
        self.levels, self.settled = [], []
        drop_path(self.spark, self.at)


def _lines(text):
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def dedup_lines(docs: DataFrame, least_docs: int = 10, least_chars: int = 1, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES, keep_text: bool = True) -> DataFrame:
    """docs with n_lines, n_dropped, kept_sha256 and, if asked for, kept_text.

    A line's key is the line without white space at its ends, A-Z lower-cased. Keys of at least
    least_chars code points that are found in at least least_docs documents lose all their lines in
    every document; the other lines stay as they are, joined by line feeds. A null or empty text is
    one empty line; a text of which no line stays is empty. Every row is a document, repeated rows
    too, whatever their ids, nulls included; a key counts once for a document however often it is
    there. Input columns named as an output column, in any case, are replaced. An empty table gives
    an empty result. Texts may be of any length; keys are told apart by 128 bits.
    """
    spark = docs.sparkSession
    docs = without(docs, [*OUTPUT[: 3 + keep_text], "__of"])
    # rows of equal id and text have equal lines, and so share what is dropped
    own = lambda seed: F.xxhash64(F.lit(seed), F.col(id_col).cast("string"), F.col(text_col))
    docs = docs.withColumn("__of", F.struct(own(5).alias("a"), own(31).alias("b")))
    fit = F.char_length("key") >= least_chars
    keys = docs.select(F.pmod(F.col("__of.a"), F.lit(batches)).cast("int").alias("batch"), F.explode(F.array_distinct(F.transform(_lines(F.col(text_col)), key_of))).alias("key")).where(fit)
    keys = written(keys.select("batch", hashes(F.col("key")).alias("h")).select("batch", "h.*"), "keys")
    runs = LineRuns(spark, least_docs)
    for b in range(batches):
        runs.add(keys.where(F.col("batch") == b).select(*KEY))
    common = runs.common()
    runs.drop()
    drop_written(keys)
    # lines of common keys, found through a bounded filter; a common key has one row, so a hot one is a join that Spark may split
    lines = docs.select("__of", F.posexplode(_lines(F.col(text_col))).alias("pos", "line")).select("__of", "pos", key_of(F.col("line")).alias("key")).where(fit).select("__of", "pos", hashes(F.col("key")).alias("k"))
    hit = only(lines, common.select(F.struct(*KEY).alias("few")), "k", "few")
    gone = hit.groupBy(F.col("__of").alias("__doc")).agg(F.array_sort(F.collect_set("pos")).alias("__at"))
    gone = written(gone.select("__doc", _flags("__at").alias("__gone")), "gone")
    drop_written(common)
    met = attach(docs, gone, "__of", "__doc").withColumn("__lines", _lines(F.col(text_col)))
    kept = F.when(F.col("__gone").isNull(), F.col("__lines")).otherwise(F.filter("__lines", lambda _, i: ~F.coalesce(F.get("__gone", i), F.lit(False))))
    out = met.withColumn("__kept", kept)
    out = out.withColumns({"n_lines": F.size("__lines").cast("long"), "n_dropped": (F.size("__lines") - F.size("__kept")).cast("long"), "kept_text": F.array_join("__kept", "\n")})
    out = out.withColumn("kept_sha256", F.sha2(F.col("kept_text").cast("binary"), 256))
    return out.select(*[f"`{c}`" for c in docs.columns if c != "__of"], *OUTPUT[: 3 + keep_text])


def _flags(places: str):
    """An array of booleans, true at the sorted places and no longer than they need: a run of false and a true for each."""
    gap = lambda p, i: p - F.coalesce(F.get(places, i - 1), F.lit(-1)) - 1
    return F.flatten(F.transform(places, lambda p, i: F.concat(F.array_repeat(F.lit(False), gap(p, i)), F.array(F.lit(True)))))


def op11_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs, keep_text=False).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


SQL = f"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key FROM l),
c AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
g AS (SELECT k.*, c.key IS NOT NULL AS gone FROM k LEFT JOIN c USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM g GROUP BY doc_id
"""
