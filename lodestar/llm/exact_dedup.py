"""Exact dedup by two-pass Bloom filtering, with DataFrame functions only.

Pass one inserts the hash of every text into a register-blocked Bloom filter: one bit of one 64-bit
register. A register also counts its insertions, and tasks merge theirs before anything is sent.
Registers with fewer bits than insertions have met a bit twice, and so has every register of a
repeated text. Pass two probes these with every row: rows that miss go straight to the result, and
only the rest are shuffled and grouped by SHA-256, ids and digests without texts. There are at most
MAX_WORDS registers, so they can be broadcast whatever the input; a filter that is too full only
lets more rows through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, folded, without, written

#: Bound of the broadcast filter, in registers.
MAX_WORDS = 1 << 21
OUTPUT = ["keep_id", "group_size", "kept", "text_sha256"]


def _words(rows: int) -> int:
    """A power of two of registers, for two rows or fewer in each up to the bound."""
    return min(MAX_WORDS, max(1024, 1 << max(0, rows // 2).bit_length()))


def _word(words: int):
    return F.xxhash64("text_sha256").bitwiseAND(F.lit(words - 1))


def repeat_filter(digests: DataFrame, words: int) -> DataFrame:
    """(__w): the registers that may hold a repeated digest."""
    bit = F.expr("shiftleft(1L, cast(shiftrightunsigned(xxhash64(text_sha256), 58) as int))")
    registers = digests.select(_word(words).alias("__w"), bit.alias("__bit")).groupBy("__w").agg(F.count("*").alias("__n"), F.bit_or("__bit").alias("__bits"))
    return registers.where(F.bit_count("__bits") < F.col("__n")).select("__w")


def _decided(rows: DataFrame, id_col: str, digests: DataFrame) -> DataFrame:
    """rows (with text_sha256) and keep_id, group_size, kept; digests are those of rows."""
    words = _words(digests.count())
    twice = F.broadcast(repeat_filter(digests, words))
    marked = rows.join(twice, _word(words) == F.col("__w"), "left")
    own = [f"`{c}`" for c in rows.columns]
    alone = marked.where("__w IS NULL").select(*own, F.col(id_col).alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    again = marked.where("__w IS NOT NULL").select(*own)
    few = digests.join(twice, _word(words) == F.col("__w"), "left_semi")
    # a row for each group and task is shuffled; the rebalance leaves a join that Spark may split at a hot group
    groups = few.groupBy(F.col("text_sha256").alias("__sha")).agg(F.max(id_col).alias("keep_id"), F.count("*").alias("group_size")).hint("rebalance")
    joined = again.join(groups, F.col("text_sha256") == F.col("__sha")).withColumn("kept", F.col(id_col).eqNullSafe(F.col("keep_id")))
    return alone.unionByName(joined.select(*alone.columns))


def _digests(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text_sha256), from the only scan of the texts that pass one needs."""
    return written(docs.select(f"`{id_col}`", F.sha2(folded(F.col(text_col)).cast("binary"), 256).alias("text_sha256")), "digests")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with keep_id, group_size, kept and text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. The largest id of
    a group stays. Rows that repeat both id and text cannot be told apart and share one decision;
    a null id never stays while the group has another. Input columns named as an output column, in
    any case, are replaced. An empty table gives an empty result. Texts may be of any length.
    """
    docs = without(docs, OUTPUT)
    digests = _digests(docs, id_col, text_col)
    return _decided(docs.withColumn("text_sha256", F.sha2(folded(F.col(text_col)).cast("binary"), 256)), id_col, digests)


def decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """exact_dedup() without the columns of docs other than the id; texts are read once."""
    digests = _digests(docs, id_col, text_col)
    return _decided(digests, id_col, digests)


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with their own columns; texts of rows that a filter of the dropped ones rejects are not shuffled."""
    # columns of docs are carried under a name that cannot clash
    safe = docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("__row"), F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    gone = written(decisions(safe, "__id", "__text").where("NOT kept").select(F.struct("__id", "text_sha256").alias("__gone")).distinct(), "gone")
    own = F.struct("__id", F.sha2(folded(F.col("__text")).cast("binary"), 256).alias("text_sha256"))
    return attach(safe.select("__row", own.alias("__own")), gone, "__own", "__gone").where("__gone IS NULL").select("__row.*")


def op1_exact_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return decisions(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


SQL = f"""
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM t
"""
