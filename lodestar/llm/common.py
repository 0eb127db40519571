"""Helpers that the training-data operators share: scratch tables, components, columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..session import FILTER_WORDS, drop_path, only, shared_dir, ship  # noqa: F401  operators take them from here
from ..session import drop_saved as drop_written
from ..session import saved as written

#: The letters that the contracts fold, and no others.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def settle(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of steps whose results are written: it does so when the driver collects what refers to them."""
    spark._jvm.System.gc()


def small_batches(spark: SparkSession, rows: int = 256) -> None:
    """Arrow batches of so many rows, for whole long texts in bounded memory, in workers that know this package."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """df without columns whose name equals one of names in any case: the operator's own replace them."""
    own = {n.lower() for n in names}
    return df.select(*[f"`{c}`" for c in df.columns if c.lower() not in own])


def folded(text):
    """Lower-case A-Z only; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


#: Edges that a task unites at once; no more of them than this are united by one task at the end.
UNITED = 1 << 18


def united(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, root) that connect what edges (u, v) connect; a root is the smallest node of its tree."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    root = np.arange(len(nodes))
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            break
        # larger roots go below the smallest root they meet; then every node to its root
        np.minimum.at(root, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (up := root[root]).tobytes() != root.tobytes():
            root = up
    own = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[own], nodes[root[own]]


def _forest(e: DataFrame, count: Observation) -> DataFrame:
    """Edges (u, v) of the same components, no more than nodes in every UNITED edges of a task: where a task has no more, each node once, with its root; counted."""
    kinds = [e.schema[c].dataType.simpleString() for c in ("u", "v")]

    def run(batches):
        held, n = [], 0

        def out():
            u, v = united(*(pa.chunked_array([b.column(k) for b in held]).to_numpy() for k in (0, 1)))
            return pa.RecordBatch.from_arrays([pa.array(u, held[0].column(0).type), pa.array(v, held[0].column(1).type)], names=["u", "v"])

        for batch in batches:
            for at in range(0, batch.num_rows, UNITED):
                part = batch.slice(at, UNITED)
                if n + part.num_rows > UNITED:
                    yield out()
                    held, n = [], 0
                held.append(part)
                n += part.num_rows
        if held:
            yield out()

    ship(e.sparkSession)
    return e.mapInArrow(run, f"u {kinds[0]}, v {kinds[1]}").observe(count, F.count(F.lit(1)).alias("n"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of edges (a, b): the smallest node reachable.

    Tasks unite the edges that they hold; up to UNITED edges that are left go to one task, which ends it.
    More take alternating large-star and small-star rounds, each written to the shared folder, until
    every edge leads from a node to its root or so few are left. A large star pre-aggregates the minimum
    by node, so a hub is never gathered in one task: the join on the hub is one that Spark may split.
    """
    e, count = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), Observation()
    e = written(_forest(e, count), "cc")
    while True:
        if count.get["n"] <= UNITED:
            nxt = written(_forest(e.coalesce(1), Observation()), "cc")
            drop_written(e)
            e = nxt
            break
        # settled: nobody has two roots, or a root and followers
        roles = e.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(e.select("v", F.lit(0), F.lit(1)))
        if roles.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR (up = 1 AND down = 1)").isEmpty():
            break
        # large star: each larger neighbour of u goes to the smallest of u's neighbourhood
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m")).hint("rebalance")
        large = both.where("v > u").join(low, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: each smaller neighbour of u, and u, go to the smallest of them
        low2 = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m").hint("rebalance")
        small = large.join(low2, F.col("u") == F.col("k"))
        pairs = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v")))
        count = Observation()
        nxt = written(_forest(pairs.where("u <> v").distinct(), count), "cc")
        drop_written(e)
        e = nxt
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def attach(big: DataFrame, few: DataFrame, key: str, few_key: str) -> DataFrame:
    """Left join of big with few on a key; rows of big that a bounded Bloom filter rejects pass straight, without a shuffle."""
    n = few.count()
    words = min(FILTER_WORDS, max(64, 1 << max(0, n // 4).bit_length()))
    h = F.xxhash64(F.col(key), F.lit(98))
    bit = lambda h, at: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, at).bitwiseAND(F.lit(63)).cast("int"))
    mask = lambda h: bit(h, 57).bitwiseOR(bit(h, 51)).bitwiseOR(bit(h, 45))
    g = F.xxhash64(F.col(few_key), F.lit(98))
    table = few.select(g.bitwiseAND(F.lit(words - 1)).alias("__w"), mask(g).alias("__m")).groupBy("__w").agg(F.bit_or("__m").alias("__m"))
    probed = big.join(F.broadcast(table), h.bitwiseAND(F.lit(words - 1)) == F.col("__w"), "left").withColumn("__hit", F.coalesce(F.col("__m").bitwiseAND(mask(h)) == mask(h), F.lit(False))).drop("__w", "__m")
    joined = probed.where("__hit").drop("__hit").join(few, F.col(key) == F.col(few_key), "left")
    alone = probed.where("NOT __hit").drop("__hit").select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in few.schema.fields])
    return joined.unionByName(alone)
