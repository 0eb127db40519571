"""Hard negatives by norm-bucketed search.

Candidates are sorted by norm, largest first, and cut into buckets; slices hold runs of buckets.
A block of questions (anchors and their windows of scores) meets a slice as one sorted stream: the
questions first, then the slice's buckets in order. No inner product with a bucket can exceed the
product of a question's norm and the bucket's largest norm, so a bucket is skipped where this lies
under the lower limit of every window or under its running kth score. The first slices, of the
largest norms, are searched alone; their kth scores are limits from the start in the others.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_written, ship, written

#: Questions in a block, candidates in a bucket, rows from which there are further slices, and slices of a small table.
BLOCK, BUCKET, SLICE, SLICES = 4096, 1024, 1 << 18, 24
#: The part of the slices that is searched first.
HEAD = 8
FOUND = "anchor_id long, nth int, id long, score long"


def quantised(vectors: DataFrame, id_col: str, vec_col: str, label) -> DataFrame:
    """(id, label, v, dim, norm) of the rows that take part; v has floor(256 * x), norm is rounded up."""
    v = F.col(vec_col)
    fine = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")).cast("double")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.when(fine, v).alias("v")).where("id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL")
    rows = rows.withColumn("v", F.transform("v", lambda x: F.floor(F.lit(256.0) * x.cast("double")).cast("long")))
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return rows.withColumn("dim", F.size("v")).withColumn("norm", F.sqrt(square) * (1 + 1e-9))


def bucketed(rows: DataFrame) -> tuple[DataFrame, int]:
    """rows with place (in the order of norms within a dimension, largest first), slice and reach (the largest norm of the row's bucket), as a table; the number of slices.

    Ranges are sorted as they are written, and a row's place is its place in the range behind all
    rows of earlier ranges, so equal norms, however many, are cut as any others.
    """
    order = ["dim", F.desc("norm"), "id"]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    ranged = written(ranged.withColumn("__range", F.shiftright("__at", 33)), "norms")
    own = ranged.groupBy(F.col("__range").alias("__r")).agg(F.count("*").alias("__n"))
    before = own.select("__r", (F.sum("__n").over(Window.orderBy("__r")) - F.col("__n")).alias("__before"))
    n = ranged.count()
    # a row for each shuffle partition
    placed = ranged.join(F.broadcast(before), F.col("__range") == F.col("__r"))
    placed = placed.withColumn("place", F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))).drop("__at", "__range", "__r", "__before")
    slices = max(1, min(SLICES, n // BUCKET), n // SLICE)
    placed = placed.withColumn("bucket", F.expr(f"place div {BUCKET}")).withColumn("slice", F.expr(f"cast(place * {slices} div {max(n, 1)} as int)"))
    reach = placed.groupBy(F.col("bucket").alias("__b"), F.col("dim").alias("__d")).agg(F.max("norm").alias("reach"))
    out = written(placed.join(reach, (F.col("bucket") == F.col("__b")) & (F.col("dim") == F.col("__d"))).drop("__b", "__d", "bucket"), "buckets")
    drop_written(ranged)
    return out, slices


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of integer rows, exact: in doubles where no sum can pass 2^53, else in 64 bits, else in Python's integers, held to 64 bits."""
    most = (float(np.abs(a).max(initial=0)) + 1) * (float(np.abs(b).max(initial=0)) + 1) * max(a.shape[1], 1)
    if most < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most < 2**62:
        return a @ b.T
    exact = a.astype(object) @ b.astype(object).T if a.shape[1] else np.zeros((len(a), len(b)), object)
    return np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64)


class _Search:
    """The running best of one block's windows: k candidates each, by score and then id."""

    def __init__(self, k: int, same: bool):
        self.k, self.same = k, same
        self.asked = []

    def question(self, ids: np.ndarray, labels: np.ndarray, v: np.ndarray, windows: list[np.ndarray]) -> None:
        self.asked.append((ids, labels, v, windows))

    def begin(self) -> None:
        """own: the anchor of each window."""
        ids, labels, v, windows = zip(*self.asked)
        self.anchor, self.label, self.q = np.concatenate(ids), np.concatenate(labels), np.concatenate(v)
        each = [w.reshape(-1, 4) for some in windows for w in some]
        self.own = np.repeat(np.arange(len(each)), [len(w) for w in each])
        self.nth, low, self.high, kth = np.concatenate(each).T
        self.norm = np.sqrt((self.q.astype(np.float64) ** 2).sum(1)) * (1 + 1e-9)
        self.floor = np.maximum(low, kth)
        self.pool = [np.zeros(0, np.int64)] * 3
        self.settled = 0

    def meet(self, ids, labels, v, reach: float) -> None:
        """One run of candidates of a bucket: none of it has an inner product over norm * reach."""
        open_ = self.norm[self.own] * reach >= self.floor
        if not open_.any():
            return
        rows = np.flatnonzero(np.bincount(self.own[open_], minlength=len(self.anchor)))
        score = _product(self.q[rows], v)
        fits = (labels[None, :] == self.label[rows, None]) == self.same
        if self.same:
            fits &= ids[None, :] != self.anchor[rows, None]
        at = np.full(len(self.anchor), -1)
        at[rows] = np.arange(len(rows))
        for w in np.array_split(np.flatnonzero(open_), max(1, open_.sum() * len(ids) >> 20)):
            s = score[at[self.own[w]]]
            x, y = np.nonzero(fits[at[self.own[w]]] & (s >= self.floor[w, None]) & (s <= self.high[w, None]))
            self.pool = [np.concatenate(p) for p in zip(self.pool, (w[x], s[x, y], ids[y]))]
            if len(self.pool[0]) > self.settled + 65536:
                self.settle()

    def settle(self) -> None:
        """Keep each window's k best; a full window's last score is its floor. Ties stay open: a smaller id may follow."""
        w, s, i = self.pool
        order = np.lexsort((i, -s, w))
        w, s, i = w[order], s[order], i[order]
        begin = np.searchsorted(w, w)
        keep = np.arange(len(w)) - begin < self.k
        last = np.arange(len(w)) - begin == self.k - 1
        self.floor[w[last]] = np.maximum(self.floor[w[last]], s[last])
        self.pool = [w[keep], s[keep], i[keep]]
        self.settled = int(keep.sum())

    def result(self) -> pa.RecordBatch:
        self.settle()
        w, s, i = self.pool
        return pa.RecordBatch.from_arrays([pa.array(self.anchor[self.own[w]]), pa.array(self.nth[w], pa.int32()), pa.array(i), pa.array(s)], names=["anchor_id", "nth", "id", "score"])


def _runner(k: int, same: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, key, asking = None, None, True
        for batch in batches:
            if not batch.num_rows:
                continue
            col = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in ("block", "slice", "kind", "id", "label", "windows", "reach")}
            lists = batch.column("v")
            flat, ends = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
            starts = np.concatenate([[0], np.cumsum(ends)])
            # runs of one block, slice, kind and bucket, of a bounded length
            marks = np.stack([col["block"], col["slice"], col["kind"]])
            cut = np.flatnonzero((np.diff(marks, axis=1) != 0).any(0) | (np.diff(col["reach"]) != 0)) + 1
            cut = np.unique(np.concatenate([[0], cut, np.arange(0, batch.num_rows, BUCKET), [batch.num_rows]]))
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
                own = (col["block"][a], col["slice"][a])
                v = flat[starts[a] : starts[b]].reshape(b - a, -1) if starts[b] > starts[a] else np.zeros((b - a, 0), np.int64)
                if own != key:
                    if search is not None and not asking:
                        yield search.result()
                    search, key, asking = _Search(k, same), own, True
                if col["kind"][a] == 0:
                    search.question(col["id"][a:b], col["label"][a:b], v, list(col["windows"][a:b]))
                    continue
                if asking:
                    search.begin()
                    asking = False
                search.meet(col["id"][a:b], col["label"][a:b], v, float(col["reach"][a]))
        if search is not None and not asking:
            yield search.result()

    return run


def _searched(asking: DataFrame, windows: DataFrame, candidates: DataFrame, slices: tuple[int, int], k: int, same: bool) -> DataFrame:
    """(anchor_id, nth, id, score): the k best of each window in each slice of the range. asking: (block, id, label, dim, v), windows: (of, nth, low, high, kth)."""
    first, last = slices
    window = F.array(*[F.col(c).cast("long") for c in ("nth", "low", "high", "kth")])
    own = windows.groupBy("of").agg(F.flatten(F.collect_list(window)).alias("windows"), F.min(F.greatest("low", "kth")).alias("floor"))
    questions = asking.join(own, F.col("id") == F.col("of")).drop("of")
    asked = questions.select("block", F.explode(F.sequence(F.lit(first), F.lit(last - 1))).alias("slice"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("place"), "id", "label", "v", "windows", F.lit(0.0).alias("reach"))
    # what the windows of a block can ask of a bucket, three numbers for each block
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    blocks = questions.select("block", "dim", "floor", norm.alias("norm")).groupBy("block", "dim").agg(F.max("norm").alias("norm"), F.min("floor").alias("floor"))
    every = blocks.agg(F.collect_list(F.struct("block", "dim", "norm", "floor")).alias("blocks"))
    wanted = F.filter("blocks", lambda b: (b["dim"] == F.col("dim")) & (b["norm"] * F.col("reach") * (1 + 1e-9) >= b["floor"]))
    met = candidates.where((F.col("slice") >= first) & (F.col("slice") < last)).join(F.broadcast(every)).select("*", F.explode(F.transform(wanted, lambda b: b["block"])).alias("block"))
    met = met.select("block", "slice", F.lit(1).alias("kind"), "place", "id", "label", "v", F.lit(None).cast("array<long>").alias("windows"), "reach")
    stream = asked.unionByName(met).repartition("block", "slice").sortWithinPartitions("block", "slice", "kind", "place", "id")
    return stream.mapInArrow(_runner(k, same), FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    over = Window.partitionBy("anchor_id", "nth").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(over)).where(F.col("rank") <= k)


def nearest(asking: DataFrame, windows: DataFrame, candidates: DataFrame, slices: int, k: int, same: bool) -> DataFrame:
    """(anchor_id, nth, id, score, rank): the k best candidates of each window, in two steps; the first gives the second its limits."""
    head = max(1, slices // HEAD)
    first = written(_best(_searched(asking, windows, candidates, (0, head), k, same), k), "found")
    if head == slices:
        return first
    full = first.where(F.col("rank") == k).select(F.col("anchor_id").alias("__a"), F.col("nth").alias("__nth"), F.col("score").alias("__kth"))
    tighter = windows.join(full, (F.col("of") == F.col("__a")) & (F.col("nth") == F.col("__nth")), "left")
    tighter = tighter.select("of", "nth", "low", "high", F.coalesce("__kth", "kth").alias("kth"))
    rest = _searched(asking, tighter, candidates, (head, slices), k, same)
    out = written(_best(first.drop("rank").unionByName(rest), k), "found")
    drop_written(first)
    return out


def mine(vectors: DataFrame, anchor, label, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the rows that anchor (a condition on id) names.

    Scores are integer inner products of floor(256 * x), ties go to the smaller id. Positives are
    the best rows of the anchor's label, negatives the best of other labels whose score is low to
    high hundredths of the positive's. Rows of null id, label or vector, or with a null, NaN or
    infinite component, take no part. Vectors meet those of their own length only; empty ones score
    0. A row of an anchor's id is no positive of it; of anchors of equal id the one of the smallest
    label and vector asks; other rows of equal id are candidates each, and positives of equal id
    each have negatives. Scores beyond 64 bits are held at the bounds. A positive score under 0 has
    no negatives, since its limits cross. An empty table gives no rows; columns other than id, label
    and vector are not read.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows, slices = bucketed(quantised(vectors, id_col, vec_col, label))
    asking = rows.where(anchor(F.col("id"))).groupBy("id").agg(F.min(F.struct("label", "dim", "v")).alias("a")).select("id", "a.*")
    blocks = max(1, math.ceil(rows.where(anchor(F.col("id"))).count() / BLOCK))
    # a block holds vectors of one length
    asking = written(asking.withColumn("block", F.xxhash64("dim", F.pmod(F.xxhash64("id"), F.lit(blocks)))), "anchors")
    least, most = F.lit(-(2**63)).cast("long"), F.lit(2**63 - 1).cast("long")
    every = asking.select(F.col("id").alias("of"), F.lit(1).alias("nth"), least.alias("low"), most.alias("high"), least.alias("kth"))
    near = nearest(asking, every, rows, slices, positives, True)
    # 30 p <= 100 s <= 90 p, in whole numbers
    p = F.col("score").cast("decimal(38,0)")
    windows = near.select(F.col("anchor_id").alias("of"), F.col("rank").alias("nth"), F.ceil(p * low / 100).cast("long").alias("low"), F.floor(p * high / 100).cast("long").alias("high"), least.alias("kth")).where("low <= high")
    far = nearest(asking, windows, rows, slices, negatives, False)
    drop_written(asking)
    drop_written(rows)
    out = far.select("anchor_id", "nth", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    own = near.select(F.col("anchor_id").alias("__a"), F.col("rank").alias("__nth"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = out.join(own, (F.col("anchor_id") == F.col("__a")) & (F.col("nth") == F.col("__nth")))
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_hard_negatives(spark, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"), lambda i: i % 100 == 0, label)


SQL = """
WITH r AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, embedding AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND list_count(embedding) = len(embedding) AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0),
q AS (SELECT id, label, list_transform(e, lambda x: floor(256 * x::DOUBLE)) AS v FROM r),
s AS (SELECT a.id AS a, c.id AS c, a.label = c.label AS same, list_inner_product(a.v, c.v)::BIGINT AS score FROM q a JOIN q c ON a.id % 100 = 0 AND a.id <> c.id AND len(a.v) = len(c.v)),
p AS (SELECT a, c AS p, score AS ps FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, c) <= 5)
SELECT p.a AS anchor_id, p.p AS positive_id, CAST(row_number() OVER (PARTITION BY p.a, p.p ORDER BY s.score DESC, s.c) AS INT) AS rank, s.c AS negative_id, ps AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.a = p.a AND NOT s.same AND 30 * ps <= 100 * s.score AND 100 * s.score <= 90 * ps
QUALIFY rank <= 10
"""
