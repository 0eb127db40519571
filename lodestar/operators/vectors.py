"""Vectors of texts, and an index of vectors by cells.

A text's vector is the sum of its terms' vectors, scaled to length 1. Terms have static vectors: the
signs of the bits of their digests (a signed random projection of the bag of terms), or those of a
table that is handed in. The index deals vectors to the cells of their nearest centres, learned by
k-means on a bounded sample, and stores them by cell. A question reads the cells that can be expected
to hold its answers, or, exactly, all cells that its best answers so far do not rule out.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..session import drop_saved, saved, ship
from ..sources.versions import Versioned

#: Components of a text's vector, and the largest number of components that an index takes.
DIM, MOST_DIM = 64, 4096
#: Bounds: components of all centres together, cells of an index, rows a cell that centres are learned from, parts that cells are stored in.
CENTRES, MOST_CELLS, ROWS_A_CELL, PARTS = 1 << 22, 1 << 16, 64, 256
#: Pages whose terms' digests are laid out at once.
AT_ONCE = 64
#: Components of the vectors, and of the questions, that meet in one task.
MET = 1 << 20
TABLE = "part int, kind int, cell int, id string, n long, near double, far double, spread double, embedding array<double>"


def _digest(term: bytes, dim: int) -> bytes:
    """As many bits as there are components: digests of the term, numbered, 128 bits each."""
    return b"".join(hashlib.md5(b"%d:%s" % (k, term)).digest() for k in range(-(-dim // 128)))


def _summed(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            digests = lists.flatten()
            width = -(-dim // 128) * 16
            # digests lie one after another in the batch's own memory
            at = np.frombuffer(digests.buffers()[1], np.int64 if pa.types.is_large_binary(digests.type) else np.int32)[digests.offset : digests.offset + len(digests) + 1] if len(digests) else [0, 0]
            raw = np.frombuffer(digests.buffers()[2], np.uint8)[at[0] : at[-1]].reshape(-1, width) if at[-1] > at[0] else np.zeros((0, width), np.uint8)
            ends = np.concatenate([[0], np.cumsum(np.diff(lists.offsets.to_numpy()))])
            sums = np.zeros((batch.num_rows, dim), np.int64)
            for k in range(batch.num_rows):
                for a in range(ends[k], ends[k + 1], 65536):
                    part = raw[a : min(a + 65536, ends[k + 1])]
                    sums[k] += 2 * np.unpackbits(part, axis=1)[:, :dim].sum(0, dtype=np.int64) - len(part)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * dim), pa.array(sums.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), flat], names=["id", "sums"])

    return run


def _vectors(dim: int):
    """(id, embedding) of batches (id, terms): a batch's distinct terms are digested once."""
    summed = _summed(dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            words = lists.flatten().dictionary_encode()
            digests = pa.array([_digest(t, dim) for t in words.dictionary.cast(pa.binary()).to_pylist()], pa.binary())
            ends = np.concatenate([[0], np.cumsum(np.diff(lists.offsets.to_numpy()))]).astype(np.int32)
            for a in range(0, batch.num_rows, AT_ONCE):
                part = ends[a : a + AT_ONCE + 1]
                own = pa.ListArray.from_arrays(pa.array(part - part[0]), digests.take(words.indices.slice(part[0], part[-1] - part[0])))
                (out,) = summed([pa.RecordBatch.from_arrays([batch.column(0).slice(a, AT_ONCE), own], names=["id", "digests"])])
                x = out.column(1).flatten().to_numpy().reshape(-1, dim).astype(float)
                length = np.sqrt((x**2).sum(1, keepdims=True))  # squares of whole numbers: exact in any order
                x = np.divide(x, length, out=np.zeros_like(x), where=length > 0)
                yield pa.RecordBatch.from_arrays([out.column(0), pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * dim), pa.array(x.ravel()))], names=["id", "embedding"])

    return run


def unit(sums: Column) -> Column:
    """A vector at length 1; a vector of length 0 stays."""
    length = F.sqrt(F.aggregate(sums, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(sums, lambda x: F.when(length > 0, x.cast("double") / length).otherwise(F.lit(0.0)))


def embedded(pages: DataFrame, dim: int = DIM, content: str = "content") -> DataFrame:
    """(id, embedding) of every page, without a shuffle: each term adds or takes 1 from each component, by the bits of its digest.

    A null or empty text, or one of stop words only, has components of 0. The same text has the same
    vector everywhere and always. Repeated terms count as often as they are there.
    """
    if not 1 <= dim <= MOST_DIM:
        raise ValueError(f"dim must be 1 to {MOST_DIM}")
    ship(pages.sparkSession)
    terms = pages.select(F.col("id").cast("string").alias("id"), text.tokens(F.coalesce(F.col(content), F.lit(""))).alias("terms"))
    return terms.mapInArrow(_vectors(dim), "id string, embedding array<double>")


def embedded_by(pages: DataFrame, terms: DataFrame, content: str = "content") -> DataFrame:
    """(id, embedding) of every page by a table of vectors (term, embedding), of one length; terms that it lacks add nothing.

    Pages without a known term have a null embedding. Of several vectors for one term the first counts.
    """
    own = terms.groupBy(F.col("term").alias("t")).agg(F.min("embedding").alias("v")).hint("rebalance")
    counts = pages.select(F.col("id").cast("string").alias("id"), F.explode(text.tokens(F.coalesce(F.col(content), F.lit("")))).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))
    met = counts.join(own, F.col("term") == F.col("t")).select("id", "term", F.transform("v", lambda x: x.cast("double") * F.col("tf")).alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come in the order of their pages and terms; a page may span batches."""
        key, total = None, None

        def out():
            return pa.RecordBatch.from_arrays([pa.array([key]), pa.array([total.tolist()], pa.list_(pa.float64()))], names=["id", "sums"])

        for batch in batches:
            for page, v in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if page != key:
                    if key is not None:
                        yield out()
                    key, total = page, np.zeros(len(v))
                total = total + np.array(v)
        if key is not None:
            yield out()

    # a sum in a fixed order, so that it is the same every time
    sums = met.repartition("id").sortWithinPartitions("id", "term").mapInArrow(run, "id string, sums array<double>")
    ids = pages.select(F.col("id").cast("string").alias("id"))
    return ids.join(sums.withColumnRenamed("id", "__id"), F.col("id") == F.col("__id"), "left").select("id", unit(F.col("sums")).alias("embedding"))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def _near(centres: np.ndarray):
    """(cell, near): the nearest centre of each row and the distance to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = (centres**2).sum(1)
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
            cell = np.concatenate([(own - 2 * x[a : a + 1024] @ centres.T).argmin(1) for a in range(0, len(x), 1024)] or [np.zeros(0, np.int64)])
            near = np.sqrt(((x - centres[cell]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell, pa.int32()), pa.array(near)], names=["id", "embedding", "cell", "near"])

    return run


def _learned(sample: DataFrame, k: int, rounds: int, seed: int) -> np.ndarray:
    """k centres at most, by rounds of k-means over a sample (id, embedding): tasks add up the rows of each centre, then cells add up the tasks' sums."""
    import pandas as pd

    first = sample.select("embedding").distinct().orderBy(F.xxhash64(F.lit(seed), "embedding")).limit(k)
    centres = np.stack([np.array(r["embedding"]) for r in first.collect()])  # CENTRES components at most

    def sums(centres: np.ndarray):
        near = _near(centres)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, n = np.zeros(centres.shape), np.zeros(len(centres), np.int64)
            for batch in batches:
                for out in near([batch]):
                    cell = out.column(2).to_numpy()
                    np.add.at(total, cell, out.column(1).flatten().to_numpy().reshape(len(cell), -1))
                    n += np.bincount(cell, minlength=len(n))
            own = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(n[own]), pa.array(total[own].tolist(), pa.list_(pa.float64()))], names=["cell", "n", "sums"])

        return run

    def added(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"cell": [rows["cell"][0]], "n": [rows["n"].sum()], "sums": [np.stack(rows.sort_values("n")["sums"].tolist()).sum(0).tolist()]})

    schema = "cell int, n long, sums array<double>"
    for _ in range(rounds):
        moved = centres.copy()
        for r in sample.mapInArrow(sums(centres), schema).groupBy("cell").applyInPandas(added, schema).collect():  # a row for each centre
            moved[r["cell"]] = np.array(r["sums"]) / r["n"]
        if np.allclose(moved, centres):
            break
        centres = moved
    return centres


def _parts(centres: np.ndarray, most: int) -> np.ndarray:
    """Which part each centre is stored in: near centres share one."""
    groups = max(1, min(most, round(math.sqrt(len(centres)))))
    heads = centres[np.random.default_rng(1).choice(len(centres), groups, replace=False)]
    for _ in range(8):
        own = ((heads**2).sum(1) - 2 * centres @ heads.T).argmin(1)
        heads = np.stack([centres[own == g].mean(0) if (own == g).any() else heads[g] for g in range(groups)])
    return ((heads**2).sum(1) - 2 * centres @ heads.T).argmin(1)


def _nearest_of(k: int, dim: int):
    """The k nearest rows of a slice (id, embedding) for every question (question, q, last), ties by id; none farther than last."""

    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        names, ids, far, at = asked.column("question"), [], [], []
        if rows.num_rows and asked.num_rows:
            flat = lambda t, c: t.column(c).combine_chunks().flatten().to_numpy().reshape(-1, dim)
            x, q, own = flat(rows, "embedding"), flat(asked, "q"), rows.column("id").to_pylist()
            last = asked.column("last").to_numpy()
            last = np.where(np.isnan(last), np.inf, last)
            xx, qq = (x**2).sum(1), (q**2).sum(1)
            # products choose the rows whose distances are then taken component by component
            slack = 1e-11 * dim * (xx.max() + qq)
            step = max(1, (1 << 22) // len(x))
            for a in range(0, len(q), step):
                part = qq[a : a + step, None] + xx - 2 * q[a : a + step] @ x.T
                most = np.partition(part, k - 1, 1)[:, k - 1] if len(x) > k else np.full(len(part), np.inf)
                most = np.minimum(most, last[a : a + step] ** 2 * (1 + 1e-9)) + 2 * slack[a : a + step]
                for i in np.flatnonzero((part <= most[:, None]).any(1)):
                    near = np.flatnonzero(part[i] <= most[i])
                    d = np.sqrt(np.add.accumulate((x[near] - q[a + i]) ** 2, 1)[:, -1])
                    if len(near) > k:
                        some = d <= np.partition(d, k - 1)[k - 1]
                        near, d = near[some], d[some]
                    best = sorted(zip(d.tolist(), (own[j] for j in near)))[:k]
                    far += [b[0] for b in best]
                    ids += [b[1] for b in best]
                    at += [a + int(i)] * len(best)
        return pa.table({"question": names.take(pa.array(at, pa.int64())).combine_chunks().cast(pa.string()), "id": pa.array(ids, pa.string()), "distance": pa.array(far, pa.float64())})

    return run


class VectorIndex:
    """Vectors (id, embedding) at a path, in versions that are swapped as a whole."""

    def __init__(self, spark: SparkSession, path: str, step=lambda name: None):
        self.spark, self.table = spark, Versioned(spark, path, step=step)
        self._known: tuple | None = None

    def build(self, vectors: DataFrame, cells: int | None = None, seed: int = 7, rounds: int = 8) -> int:
        """Put vectors in place of what is there; the version's number.

        The commonest length is the index's, the smaller of equally common ones; vectors of another
        length, nulls, and vectors with a null, NaN or infinite component are left out. Cells are as many
        as the root of the vectors' number, within MOST_CELLS and CENTRES components; their centres are
        learned from ROWS_A_CELL rows a cell at most, chosen by their ids' hashes. No vector: an empty
        version. Repeated ids are vectors of their own.
        """
        ship(self.spark)
        v = F.col("embedding").cast("array<double>")
        fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        rows = vectors.select(F.col("id").cast("string").alias("id"), v.alias("embedding")).where(F.coalesce(fine, F.lit(False)))
        # vectors may be costly to make, so they are made once
        made = saved(rows, "vectors")
        lengths = made.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
        if lengths is None:
            drop_saved(made)
            return self.table.replace(self.spark.createDataFrame([], TABLE), note=json.dumps({"dim": 0, "flat": 0.0}))
        dim, n = lengths
        if not 1 <= dim <= MOST_DIM:
            drop_saved(made)
            raise ValueError(f"vectors must have 1 to {MOST_DIM} components, not {dim}")
        rows = made.where(F.size("embedding") == dim)
        k = max(1, min(cells or round(math.sqrt(n)), n, MOST_CELLS, CENTRES // dim))
        scale = 1 << 20
        sample = rows if n <= k * ROWS_A_CELL else rows.where(F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(scale)) < int(scale * k * ROWS_A_CELL / n))
        sample = saved(sample, "sample")
        if sample.isEmpty():  # so few rows that their hashes chose none
            sample = rows
        centres = _learned(sample, k, rounds, seed)
        parts = _parts(centres, PARTS)
        # how widely directions from a centre spread: 1 over the components that matter
        left = np.stack([np.array(r["embedding"]) for r in sample.orderBy("id").limit(2048).select("embedding").collect()])  # a bounded sample of a sample
        left = left - centres[((centres**2).sum(1) - 2 * left @ centres.T).argmin(1)]
        total = np.cov(left.T, bias=True).reshape(dim, dim)
        flat = float((total**2).sum() / max(np.trace(total) ** 2, 1e-300))
        part = self.spark.createDataFrame([(i, int(p), c.tolist()) for i, (p, c) in enumerate(zip(parts, centres))], "__cell int, part int, __centre array<double>")
        dealt = saved(rows.mapInArrow(_near(centres), "id string, embedding array<double>, cell int, near double"), "dealt")
        own = dealt.groupBy("cell").agg(F.count("*").alias("n"), F.max("near").alias("far"), F.avg("near").alias("near"), F.min("near").alias("low"))
        own = own.join(F.broadcast(part), F.col("cell") == F.col("__cell"))  # a row for each centre: CENTRES components
        heads = own.select("part", F.lit(0).alias("kind"), "cell", F.lit(None).cast("string").alias("id"), "n", "near", "far", F.col("low").alias("spread"), F.col("__centre").alias("embedding"))
        body = dealt.join(F.broadcast(part.select("__cell", "part")), F.col("cell") == F.col("__cell"))
        body = body.select("part", F.lit(1).alias("kind"), "cell", "id", F.lit(1).cast("long").alias("n"), "near", F.col("near").alias("far"), F.lit(0.0).alias("spread"), "embedding")
        out = heads.unionByName(body).repartitionByRange("part", "kind", "cell", "near").sortWithinPartitions("part", "kind", "cell", "near")
        version = self.table.replace(out, note=json.dumps({"dim": int(dim), "flat": flat}), by=["part"])
        for scratch in (made, sample, dealt):
            drop_saved(scratch)
        return version

    def _cells(self):
        """(dim, flat, part, cell, n, near, far, centres) of the last version, kept until another is there; bounded by CENTRES."""
        head = self.table.head()
        if head is None:
            return None
        if self._known is None or self._known[0] != head["version"]:
            note = json.loads(head["note"])
            rows = self.table.read(head["version"]).where("kind = 0").orderBy("cell").collect()
            col = lambda c: np.array([r[c] for r in rows])
            self._known = head["version"], (note["dim"], note["flat"], col("part"), col("cell"), col("n"), col("near"), col("far"), np.array([r["embedding"] for r in rows]).reshape(len(rows), note["dim"]))
        return self._known[1]

    def _of(self, part: np.ndarray, cell: np.ndarray) -> DataFrame:
        """The vectors of some cells; parts are folders, cells are sorted in their files."""
        rows = self.table.read(self._known[0]).where((F.col("kind") == 1) & F.col("part").isin(sorted(set(part.tolist()))))
        return rows.where(F.col("cell").isin(cell.tolist())).select("id", "embedding")

    def ask(self, question: list[float], k: int = 10, recall: float = 0.95, exact: bool = False) -> DataFrame:
        """(id, distance) of the k nearest, ties by id: exactly, or so that recall of them is expected.

        The nearest cells give a first list. Vectors lie about a centre in directions of any kind, so the
        share of a cell that is nearer than the list's last is that of a normal tail; cells are read until
        those left out are expected to have less than 1 - recall of the list. The exact way reads all cells
        of which a vector can be nearer by the triangle rule. A question of another length, or with a
        component that is not finite, gives nothing, and so does an index that is not there or empty.
        """
        none = self.spark.createDataFrame([], "id string, distance double")
        known = self._cells()
        q = np.array(question, float)
        if known is None or len(q) != known[0] or not known[0] or not np.isfinite(q).all() or k < 1:
            return none
        _, flat, part, cell, n, near, far, centres = known
        away = np.sqrt(((centres - q) ** 2).sum(1))
        order = np.argsort(away, kind="stable")
        first = order[: max(1, int(np.searchsorted(np.cumsum(n[order]), 4 * k)) + 1)]
        goal = F.array(*[F.lit(float(x)) for x in q])
        nearest = lambda rows: rows.select("id", distance(F.col("embedding"), goal).alias("distance")).orderBy("distance", "id").limit(k)
        best = [r["distance"] for r in nearest(self._of(part[first], cell[first])).collect()]  # k rows
        last = best[-1] if len(best) == k else math.inf
        if exact or last == math.inf:
            take = np.flatnonzero(away - far <= last * (1 + 1e-9) + 1e-12)
        else:
            tail = (away**2 + near**2 - last**2) / np.maximum(2 * away * near * math.sqrt(flat), 1e-12)
            hits = n * np.array([0.5 * math.erfc(x / math.sqrt(2)) for x in tail])
            hits[first] = np.inf
            by = np.argsort(-hits, kind="stable")
            rest = np.concatenate([np.cumsum(hits[by][::-1])[::-1][1:], [0.0]])
            take = by[: int(np.argmax(rest <= (1 - recall) * k)) + 1]
        return nearest(self._of(part[take], cell[take]))

    def ask_all(self, questions: DataFrame, k: int = 10) -> DataFrame:
        """(question, id, distance, rank): the k nearest, exactly, of every question (question, embedding): questions go to the parts of the cells that they need.

        At first these are the nearest cells, of 4k vectors, then the cells that the first list does not rule
        out. A slice of a part meets a block of questions in one task, as matrices. Questions of another
        length, or with a component that is null or not finite, give nothing.
        """
        known = self._cells()
        schema = "question string, id string, distance double, rank int"
        if known is None or not known[0]:
            return self.spark.createDataFrame([], schema)
        dim, _, _, cell, n, _, far, centres = known
        part = known[2]
        ship(self.spark)
        v = F.col("embedding").cast("array<double>")
        fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        asked = questions.select(F.col("question").cast("string").alias("question"), v.alias("q")).where((F.size("q") == dim) & F.coalesce(fine, F.lit(False)))
        asked = saved(asked, "asked")
        blocks = max(1, -(-asked.count() * dim // MET))
        # slices of each part, by the number of its vectors
        slices = np.maximum(1, -(-np.bincount(part, weights=n).astype(np.int64) * dim // MET))
        table = self.table.read(self._known[0]).where("kind = 1").select("part", "id", "embedding")
        own = F.element_at(F.array(*[F.lit(int(x)) for x in slices]), F.col("part") + 1)
        table = table.select("part", F.pmod(F.xxhash64("id"), own).cast("int").alias("slice"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "id", "embedding")

        def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows, to, nth = [], [], []
                for i, (q, last) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                    away = np.sqrt(((centres - np.array(q)) ** 2).sum(1))
                    if last is None:
                        order = np.argsort(away, kind="stable")
                        take = order[: int(np.searchsorted(np.cumsum(n[order]), 4 * k)) + 1]
                    else:
                        take = np.flatnonzero(away - far <= last * (1 + 1e-9) + 1e-12)
                    for p in np.unique(part[take]):
                        rows += [i] * slices[p]
                        to += [p] * slices[p]
                        nth += range(slices[p])
                cols = [pa.array(to, pa.int32()), pa.array(nth, pa.int32())]
                yield pa.RecordBatch.from_arrays([*cols, *(batch.column(c).take(pa.array(rows, pa.int64())) for c in range(3))], names=["part", "slice", "question", "q", "last"])

        def listed(limits: DataFrame) -> DataFrame:
            pairs = limits.mapInArrow(parts, "part int, slice int, question string, q array<double>, last double")
            pairs = pairs.withColumn("block", F.pmod(F.xxhash64("question"), F.lit(blocks)).cast("int"))
            keys = ["part", "slice", "block"]
            met = table.groupBy(*keys).cogroup(pairs.groupBy(*keys)).applyInArrow(_nearest_of(k, dim), "question string, id string, distance double")
            return met.withColumn("rank", F.row_number().over(Window.partitionBy("question").orderBy("distance", "id"))).where(F.col("rank") <= k)

        first = listed(asked.select("question", "q", F.lit(None).cast("double").alias("last")))
        # a list that is not full rules nothing out
        last = saved(first.groupBy("question").agg(F.when(F.count("*") == k, F.max("distance")).otherwise(F.lit(float("inf"))).alias("last")), "limits")
        return listed(asked.join(last.withColumnRenamed("question", "__of"), F.col("question") == F.col("__of")).select("question", "q", "last"))
