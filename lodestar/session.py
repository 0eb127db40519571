"""What operators need of a session: this package on every worker, tables in the shared folder, places over ranges, joins behind a filter."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    top = Path(__file__).resolve().parents[1]
    at = tempfile.mkdtemp(prefix="lodestar-code-")  # the driver serves it to executors from here, as long as it lives
    atexit.register(shutil.rmtree, at, ignore_errors=True)
    with zipfile.ZipFile(f"{at}/lodestar_code.zip", "w") as out:
        for p in sorted((top / "lodestar").rglob("*.py")):
            out.write(p, p.relative_to(top))
    sc.addPyFile(f"{at}/lodestar_code.zip")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset a local session gets one of its own; a cluster must name one that all its machines see."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="lodestar-")
        atexit.register(shutil.rmtree, at, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def saved(df: DataFrame, what: str = "table") -> DataFrame:
    """df as a table in the shared folder, read again: cuts lineage and survives a lost executor."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/lodestar-{what}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def drop_path(spark: SparkSession, at: str) -> None:
    """Delete a folder, if there is one, on whatever store it is."""
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop_saved(df: DataFrame) -> None:
    """Delete the table behind a frame that saved() returned and that is not needed again."""
    at = df.inputFiles()
    if at and "/lodestar-" in at[0]:
        drop_path(df.sparkSession, at[0].rsplit("/", 1)[0])


def placed(df: DataFrame, order: list, name: str = "place", of: str | None = None) -> DataFrame:
    """df with each row's place from 0 in an order of all rows; with `of`, the sum of that column over the rows before it.

    Rows are dealt to ranges, sorted inside them, and ranges add what the ranges before them hold:
    a row for each range is all that one task ever sees.
    """
    ranged = saved(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "ranges")
    own = F.count("*") if of is None else F.sum(of)
    totals = ranged.groupBy(F.col("__range").alias("__r")).agg(own.alias("__n"))
    before = totals.select("__r", (F.sum("__n").over(Window.orderBy("__r")) - F.col("__n")).alias("__before"))
    inside = Window.partitionBy("__range").orderBy(*order)
    nth = F.row_number().over(inside) - 1 if of is None else F.sum(of).over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col(of)
    # as many rows as shuffle partitions
    return ranged.join(F.broadcast(before), F.col("__range") == F.col("__r")).withColumn(name, (F.col("__before") + nth).cast("long")).drop("__range", "__r", "__before")


#: Bound of a broadcast filter of ids: two longs for each word.
FILTER_WORDS = 1 << 20


def only(big: DataFrame, few: DataFrame, key: str, few_key: str) -> DataFrame:
    """Inner join of big with few; a bounded Bloom filter drops most other rows of big before the shuffle."""
    n = few.count()
    words = min(FILTER_WORDS, max(64, 1 << max(0, n // 4).bit_length()))

    def spot(c):
        h = F.xxhash64(c, F.lit(99))
        bit = lambda at: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, at).bitwiseAND(F.lit(63)).cast("int"))
        return h.bitwiseAND(F.lit(words - 1)), bit(57).bitwiseOR(bit(51)).bitwiseOR(bit(45))

    word, mask = spot(F.col(few_key))
    table = few.select(word.alias("__w"), mask.alias("__m")).groupBy("__w").agg(F.bit_or("__m").alias("__m"))
    word, mask = spot(F.col(key))
    near = big.join(F.broadcast(table), (word == F.col("__w")) & (F.col("__m").bitwiseAND(mask) == mask)).drop("__w", "__m")
    return near.join(few, F.col(key) == F.col(few_key))
