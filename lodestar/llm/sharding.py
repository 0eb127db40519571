"""Sharding by proportional stratified interleaving, with DataFrame functions only.

Rows of a source are shuffled by a seeded hash and ranked; rank over count is a row's place in the
mixture; all rows in the order of their places are cut into equal runs. Both rankings work in two
levels: counts of fine bins give each bin's first rank, and only rows of one bin meet in a window,
so neither a hot source nor the whole table is ever sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bins of a ranking: some ROWS_A_BIN rows each, at most MAX_BINS of them for a source.
ROWS_A_BIN, MAX_BINS = 512, 1 << 14


def _ranked(df: DataFrame, keys: list[str], bin_col: str, order: list, rank: str, total: str) -> DataFrame:
    """Adds the rank (from 0) within keys by bin and order, and the rows of keys."""
    counts = df.groupBy(*keys, bin_col).agg(F.count("*").alias("__n"))
    over = Window.partitionBy(*keys)
    first = counts.select(
        *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col(bin_col).alias("__bin"),
        (F.sum("__n").over(over.orderBy(bin_col)) - F.col("__n")).alias("__first"), F.sum("__n").over(over).alias(total),
    )
    on = (F.col(bin_col) == F.col("__bin"))
    for i, k in enumerate(keys):
        on = on & (F.col(k) == F.col(f"__k{i}"))
    near = F.row_number().over(Window.partitionBy(*keys, bin_col).orderBy(*order))
    return df.withColumn("__near", near).join(first, on).withColumn(rank, F.col("__first") + F.col("__near") - 1).drop("__near", "__bin", "__first", *[f"__k{i}" for i in range(len(keys))])


def shard(docs: DataFrame, shards: int = 24, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row for each row of docs: id, size, text_crc32, law, shard, slot, grown_shard.

    Law `rows`: shards differ by one row at most, and each holds every source in proportion. A null
    source is a source of its own; a null text has size 8 and the checksum of no bytes. Ties (equal
    hash) are ordered by id and checksum; rows alike in all of these are interchangeable. Null ids
    come first. Fewer rows than shards leave the last shards empty. Only ids, sizes and checksums
    are shuffled, never texts; other columns of docs are not read.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    n = docs.count()
    bins = 1 << min(MAX_BINS.bit_length() - 1, max(0, n // ROWS_A_BIN).bit_length())
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(
        F.col(id_col).alias("__id"), F.concat(F.when(F.col(source_col).isNull(), F.lit("0")).otherwise(F.lit("1")), F.coalesce(F.col(source_col), F.lit(""))).alias("__s"),
        (F.octet_length(raw).cast("long") + 8).alias("size"), F.crc32(raw).alias("text_crc32"),
    )
    rows = rows.withColumn("__h", F.xxhash64(F.lit(seed), F.col("__id"), F.col("text_crc32")))
    rows = rows.withColumn("__b", F.shiftrightunsigned("__h", 64 - (bins.bit_length() - 1)) if bins > 1 else F.lit(0).cast("long"))
    ranked = _ranked(rows, ["__s"], "__b", ["__h", "__id", "text_crc32"], "__r", "__t").drop("__b")
    place = ranked.withColumn("__f", (F.col("__r") + F.lit(0.5)) / F.col("__t"))
    place = place.withColumn("__b", F.least(F.floor(F.col("__f") * bins), F.lit(bins - 1)).cast("long"))
    place = place.withColumn("__all", (F.col("__b") * 0).cast("int"))
    every = _ranked(place, ["__all"], "__b", ["__f", "__h", "__id", "text_crc32"], "__g", "__n")
    # shard k takes the ranks from ceil(k * n / shards)
    every = every.withColumn("shard", F.expr(f"cast(__g * {shards} div __n as int)"))
    slot = F.expr(f"__g - (cast(shard as bigint) * __n + {shards - 1}) div {shards}")
    return every.select(F.col("__id").alias(id_col), "size", "text_crc32", F.lit("rows").alias("law"), "shard", slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op8_sharding(spark, sf_dir: str) -> DataFrame:
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"))
