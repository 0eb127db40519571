"""Streams over the same operators: new sources, weekly verdicts, limits."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship


def arrivals(spark: SparkSession, path: str, schema) -> DataFrame:
    """Parquet files as they come; a file is read once for each checkpoint."""
    return spark.readStream.schema(schema).parquet(path)


def new_contents(sources: DataFrame, delay: str = "1 day") -> DataFrame:
    """Sources (ref, hash, at) whose content was not seen within the delay."""
    return sources.withWatermark("at", delay).dropDuplicatesWithinWatermark(["hash"])


def weekly_verdicts(verdicts: DataFrame, delay: str = "1 day") -> DataFrame:
    """Verdicts of each week from Monday, once the watermark has passed it."""
    n = lambda v: F.sum((F.col("verdict") == v).cast("long"))
    w = F.window("ts", "1 week", startTime="4 days")
    return verdicts.withWatermark("ts", delay).groupBy(w.alias("w")).agg(n("pass").alias("passed"), n("fail").alias("failed"), F.count("*").alias("total")).select(F.col("w.start").alias("week"), "passed", "failed", "total")


def limited(calls: DataFrame, cap: int, seconds: int = 3600) -> DataFrame:
    """(entry, accepted) of a stream of calls (key, entry, at): a sliding window for each key, kept as state."""

    ship(calls.sparkSession)

    def fold(key, batches: Iterator[pd.DataFrame], state):
        live = list(state.get[0]) if state.exists else []
        for calls in batches:
            calls = calls.sort_values(["at", "entry"])
            answers = []
            for at in calls["at"].tolist():
                live = [t for t in live if t >= at - seconds]
                answers.append(len(live) < cap)
                if answers[-1]:
                    live.append(at)
            yield pd.DataFrame({"entry": calls["entry"], "accepted": answers})
        state.update((live,))

    return calls.groupBy("key").applyInPandasWithState(fold, "entry long, accepted boolean", "live array<long>", "append", "NoTimeout")


def compile_batches(sources: DataFrame, path: str, checkpoint: str, ingest=None, now: str | None = None):
    """Each micro-batch of sources (ref, hash) is compiled into the tables at path (see operators.compiling); a batch that is replayed changes nothing.

    The batch's number is in the manifest's pointer, so it is known after a restart too. Of several hashes of
    one source in a batch the largest counts. Without ingest, sources are only noted as done.
    """
    from ..operators.compiling import Compiler

    none = "cast(array() as array<struct<id:string,type:string,title:string,content:string>>)"

    def noted(todo: DataFrame) -> DataFrame:
        return todo.select("ref", F.lit(True).alias("ok"), F.lit(None).cast("string").alias("error"), F.expr(none).alias("pages"))

    def merge(batch: DataFrame, number: int) -> None:
        once = batch.groupBy("ref").agg(F.max_by(F.struct(*[c for c in batch.columns if c != "ref"]), "hash").alias("s")).select("ref", "s.*")
        Compiler(batch.sparkSession, path).compile(once, ingest or noted, batch=number, now=now)

    return sources.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
