"""Writers: published files, tables that are replaced as a whole, and append-only logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from .versions import Versioned

#: Bytes from which a log's month starts a further part.
LOG_BYTES = 500_000


def replace_table(df: DataFrame, path: str, batch: int | None = None) -> int:
    """Put df in place of a table's rows: readers (see read_table) see the old rows or the new ones, whenever a writer dies; the version's number."""
    return Versioned(df.sparkSession, path).replace(df, batch)


def read_table(spark, path: str) -> DataFrame | None:
    """The rows that replace_table() put in place last; None if it never did."""
    return Versioned(spark, path).read()


def append_log(df: DataFrame, path: str) -> None:
    """Append (ts, op, message) as lines by month; markup at the start of a message is escaped."""
    line = F.concat_ws(" | ", F.concat(F.lit("- "), F.date_format("ts", "yyyy-MM-dd")), "op", F.regexp_replace(F.regexp_replace("message", r"[\r\n]+", " "), r"^([#>\-\[])", r"\\$1"))
    df.select(F.date_format("ts", "yyyy-MM").alias("month"), line.alias("line")).write.mode("append").partitionBy("month").text(path)


def wipe(spark, paths: list[str]) -> None:
    """Delete derived tables, so that they are built anew, and forget what is cached."""
    from ..session import drop_path

    for path in paths:
        drop_path(spark, path)
    spark.catalog.clearCache()


def rotate_log(spark, path: str, month: str, limit: int = LOG_BYTES) -> str | None:
    """A month's part of a log that is over the limit is put away as month.1, month.2 and so on; its new name, or None."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    own = jvm.org.apache.hadoop.fs.Path(f"{path}/month={month}")
    fs = own.getFileSystem(conf)
    if not fs.exists(own) or fs.getContentSummary(own).getLength() <= limit:
        return None
    n = 1
    while fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/month={month}.{n}")):
        n += 1
    fs.rename(own, jvm.org.apache.hadoop.fs.Path(f"{path}/month={month}.{n}"))
    return f"{month}.{n}"


def append_audit(lines: DataFrame, path: str) -> None:
    """Append lines (line) of JSON, as ingest.audit() gives them."""
    lines.select("line").write.mode("append").text(path)


def page_text(fields: Column, content: Column) -> Column:
    """A page as a file has it: fields, an array of (key, values) in their order, as a header, and the content. One value stands beside its key, several below it."""
    quoted = lambda v: F.concat(F.lit('"'), text.yaml_escaped(v), F.lit('"'))
    many = lambda x: F.concat(F.lit("\n"), F.array_join(F.transform(x["values"], lambda v: F.concat(F.lit("  - "), quoted(v))), "\n"))
    line = lambda x: F.concat(x["key"], F.lit(":"), F.when(F.size(x["values"]) == 1, F.concat(F.lit(" "), quoted(F.get(x["values"], F.lit(0))))).when(F.size(x["values"]) == 0, F.lit(" []")).otherwise(many(x)))
    return F.concat(F.lit("---\n"), F.array_join(F.transform(fields, line), "\n"), F.lit("\n---\n"), content)


def files_by_type(df: DataFrame, path: str) -> None:
    """Lines (type, line), a folder for each type."""
    df.repartition("type").sortWithinPartitions("type", "id").select("type", "line").write.mode("overwrite").partitionBy("type").text(path)


def unchanged(pages: DataFrame, written_at) -> bool:
    """Whether no page is younger than what was written, so that a write can be left out."""
    newest = pages.agg(F.max("modified")).first()[0]
    return newest is not None and written_at is not None and newest <= written_at
