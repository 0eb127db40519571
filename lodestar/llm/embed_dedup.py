"""Near-dedup of vectors by spherical-cap filters from structured random product codes.

A rotated vector is cut into blocks; each block has a small random code of unit directions, and a
filter is a choice of one direction for each block. A vector is listed under every filter whose
direction it exceeds a threshold with, or else under the best one; the list is decoded from the
sorted inner products of the blocks, never by trying all filters. The threshold follows from the
dimension and the least cosine. Vectors that meet in a filter are compared in double
precision, and a pair counts in the first filter that both have.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .buffers import starts_of, whole_groups
from .common import components, drop_written, small_batches, written
from .minhash import labelled

#: Independent rotations, blocks of a vector, directions of a block, inner product from which a filter lists a unit vector of DIM dimensions, most rows compared in one task.
TURNS, PARTS, CODE, CAP, BLOCK = 5, 2, 512, 0.47, 1024
#: What CAP was chosen for: dimensions, least cosine.
DIM, LEAST = 64, 0.9
#: Vectors decoded at once; dimensions that vectors of fewer are turned into.
AT_ONCE, FEWEST = 200, 16


@lru_cache(32)
def directions(dim: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """A random rotation into FEWEST dimensions or more, and the codes of the blocks: PARTS x CODE x (dimensions / PARTS)."""
    rng = np.random.default_rng(seed)
    wide = -(-max(dim, FEWEST) // PARTS) * PARTS
    turn = np.linalg.qr(rng.standard_normal((wide, wide)))[0][:dim]
    code = rng.standard_normal((PARTS, CODE, wide // PARTS))
    return turn, code / np.linalg.norm(code, axis=2, keepdims=True)


def in_common(dim: int, cosine: float, cap: float) -> float:
    """Share of all filters that list both of two unit vectors of that cosine, for at least 4 dimensions."""
    x = np.linspace(-1, 1, 20001)
    power = np.cumsum((1 - x * x) ** ((dim - 4) / 2))  # of a coordinate of a unit vector, with one dimension less
    u = np.linspace(cap, 1, 2001)[:-1]
    weight = (1 - u * u) ** ((dim - 3) / 2)
    rest = np.sqrt(max(0.0, 1 - cosine * cosine) * (1 - u * u))
    need = np.divide(cap - cosine * u, rest, out=np.where(cosine * u >= cap, -1.0, 1.0), where=rest > 0)
    above = 1 - np.interp(need, x, power / power[-1])
    y = np.linspace(-1, 1, 20001)
    return float((weight * above).sum() * (u[1] - u[0]) / (((1 - y * y) ** ((dim - 3) / 2)).sum() * (y[1] - y[0])))


@lru_cache(256)
def cap_for(dim: int, least: float) -> float:
    """The inner product at which two vectors of cosine `least` have as many filters in common as CAP gives at DIM and LEAST; higher in few dimensions, lower in many."""
    dim, least, wanted = max(dim, FEWEST), min(least, LEAST), in_common(DIM, LEAST, CAP)
    low, high = 0.0, 0.999
    for _ in range(40):
        mid = (low + high) / 2
        low, high = (mid, high) if in_common(dim, least, mid) >= wanted else (low, mid)
    return low


def listed(unit: np.ndarray, turn: np.ndarray, code: np.ndarray, cap: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, filter) of every filter that a unit vector exceeds, or else of its best, by list decoding block after block."""
    blocks = (unit @ turn).reshape(len(unit), PARTS, -1)
    inner = np.einsum("npd,pcd->npc", blocks, code) / np.sqrt(PARTS)
    best = inner.max(2)
    rest = np.concatenate((np.cumsum(best[:, ::-1], 1)[:, ::-1], np.zeros((len(unit), 1))), 1)  # best of blocks from p on
    cap = np.minimum(cap, rest[:, 0] - 1e-12)
    row, name, sofar = np.arange(len(unit)), np.zeros(len(unit), np.int64), np.zeros(len(unit))
    for p in range(PARTS):
        order = np.argsort(-inner[:, p], 1)
        ranked = np.take_along_axis(inner[:, p], order, 1)
        need = cap[row] - sofar - rest[row, p + 1]
        many = (ranked[row] >= need[:, None]).sum(1)  # directions of this block that can still reach the cap
        k = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        row, name, sofar = (np.repeat(x, many) for x in (row, name, sofar))
        name, sofar = name * CODE + order[row, k], sofar + ranked[row, k]
    return row, name


def all_listed(unit: np.ndarray, cap: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, filter) under all rotations, sorted by row and filter."""
    rows, names = [], []
    for turn in range(TURNS):
        codes = directions(unit.shape[1], turn + 7)
        for at in range(0, len(unit), AT_ONCE):
            row, name = listed(unit[at : at + AT_ONCE], *codes, cap)
            rows.append(row + at), names.append(name * TURNS + turn)
    row, name = np.concatenate(rows), np.concatenate(names)
    order = np.lexsort((name, row))
    return row[order], name[order]


def _filters(vectors: DataFrame, least: float, cap: float | None) -> DataFrame:
    """(id, dim, filters), filters sorted; without a cap that of the dimension."""

    def run(batches):
        for batch in batches:
            kept = [np.array(v, np.float64) for v in batch.column(2).to_pylist()]
            lists: list = [None] * len(kept)
            for dim in {len(v) for v in kept}:
                at = [i for i, v in enumerate(kept) if len(v) == dim]
                unit = np.stack([kept[i] for i in at])
                scale = np.abs(unit).max(1, keepdims=True)  # else squares of tiny or huge numbers vanish or overflow
                unit = unit / scale
                unit /= np.linalg.norm(unit, axis=1, keepdims=True)
                row, name = all_listed(unit, cap_for(dim, least) if cap is None else cap)
                bounds = np.searchsorted(row, np.arange(len(at) + 1))
                for i, a, b in zip(at, bounds, bounds[1:]):
                    lists[i] = name[a:b].astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(v) for v in kept], pa.int32()), pa.array(lists, pa.list_(pa.int32()))], names=["id", "dim", "filters"])

    return vectors.select("id", "weight", "vector").mapInArrow(run, "id long, dim int, filters array<int>")


def near(a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Pairs of rows whose cosine in double precision is at least `least`."""
    norms = lambda x: np.sqrt((x * x).sum(1))
    return (a @ b.T) / (norms(a)[:, None] * norms(b)[None, :]) >= least


def flat(column) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of a column of lists without nulls."""
    lists = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks)
    offsets = lists.offsets.to_numpy()
    return lists.values.to_numpy(zero_copy_only=False), offsets


def _linked(rows: DataFrame, least: float) -> DataFrame:
    """(a, b, n): n links of a counted here, and an edge to b, from rows (dim, filter, left, right, block, id, weight, vector, filters)."""
    keys = ["dim", "filter", "left", "right"]

    def run(batches):
        for table in whole_groups(batches, keys):
            at = starts_of(table, keys)
            ids, weight, block = (table.column(c).to_numpy() for c in ("id", "weight", "block"))
            left, right, filt = (table.column(c).to_numpy() for c in ("left", "right", "filter"))
            vectors, v_at = flat(table.column("vector"))
            lists, f_at = flat(table.column("filters"))
            out_a, out_b, out_n = [], [], []
            for a, b in zip(at, at[1:]):
                v = vectors[v_at[a] : v_at[b]].reshape(b - a, -1).astype(np.float64)
                v /= np.abs(v).max(1, keepdims=True)
                hit = np.triu(near(v, v, least), 1)
                if left[a] != right[a]:
                    hit &= block[a:b, None] != block[None, a:b]
                if not hit.any():
                    continue
                live = np.flatnonzero(hit.any(0) | hit.any(1))
                earlier = [(own := lists[f_at[a + i] : f_at[a + i + 1]])[own < filt[a]] for i in live]
                names, number = np.unique(np.concatenate(earlier), return_inverse=True)
                if len(names):
                    met = np.zeros((len(live), len(names)), np.float32)
                    met[np.repeat(np.arange(len(live)), [len(e) for e in earlier]), number] = 1
                    hit[np.ix_(live, live)] &= met @ met.T == 0
                x, y = np.nonzero(hit)
                n = np.bincount(x, weight[a + y], b - a) + np.bincount(y, weight[a + x], b - a)
                roots = labelled(b - a, lambda i, hit=hit: hit[:i, i])
                own = np.flatnonzero(n)
                out_a.append(ids[a + own]), out_b.append(ids[a + roots[own]]), out_n.append(n[own].astype(np.int64))
            if out_a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (out_a, out_b, out_n)], names=["a", "b", "n"])

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long, n long")


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = LEAST, cap: float | None = None) -> DataFrame:
    """One row for each row of vectors: id, n_links, component_id, kept.

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing,
    nor do vectors of different dimensions. Equal vectors are one class: they link with each other
    and share their other links. A pair at or above `least` is found with a probability that grows
    as `cap` falls, and that by default is held over all dimensions and values of `least`; lists of
    filters grow as `least` falls. No pair below is ever linked. Rows of null id have a null component, are kept
    and link with nothing. Rows of equal id count as rows of their own in n_links. Vectors may have
    any number of dimensions, also different ones in a table. Other columns are not read; an empty
    table gives an empty result.
    """
    v = F.col(vector_col)
    fine = F.coalesce((F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False)) & F.col(id_col).isNotNull()
    rows = vectors.select(F.col(id_col).alias("id"), v.alias("vector"), fine.alias("fine"))
    classes = written(rows.where("fine").groupBy("vector").agg(F.min("id").alias("id"), F.count("*").alias("weight")).select("id", "weight", "vector"), "classes")
    small_batches(vectors.sparkSession, 2000)
    # vectors of other dimensions meet elsewhere, though filters have the same numbers
    named = written(_filters(classes, least, cap).select("id", "dim", F.explode("filters").alias("filter")), "named")
    shared = named.groupBy(F.col("dim").alias("e"), F.col("filter").alias("f")).agg(F.count("*").cast("int").alias("members")).where("members > 1").hint("rebalance")
    met = written(named.join(shared, (F.col("dim") == F.col("e")) & (F.col("filter") == F.col("f"))).drop("e", "f"), "met")
    drop_written(named)
    shared_lists = met.groupBy(F.col("id").alias("j")).agg(F.array_sort(F.collect_list("filter")).alias("filters"))
    lists = classes.join(shared_lists, F.col("id") == F.col("j")).drop("j")
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    met = met.withColumn("block", F.pmod(F.xxhash64("id"), blocks).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    met = met.select("dim", "filter", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"), "block", "id")
    full = met.join(lists.withColumnRenamed("id", "i"), F.col("id") == F.col("i")).select("dim", "filter", "left", "right", "block", "id", "weight", "vector", "filters")
    links = written(_linked(full, least), "links")
    counts = links.groupBy(F.col("a").alias("c")).agg(F.sum("n").alias("n"))
    found = components(links.select("a", "b")).withColumnRenamed("node", "d")
    of = classes.join(counts, F.col("id") == F.col("c"), "left").join(found, F.col("id") == F.col("d"), "left")
    of = of.select(F.col("vector").alias("w"), (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "id").alias("of"))
    out = rows.join(of.hint("rebalance"), F.col("fine") & (F.col("vector") == F.col("w")), "left")
    mine = F.coalesce("of", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), mine.alias("component_id"), F.col("id").eqNullSafe(mine).alias("kept"))


def op7_embedding(spark, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


#: All pairs of vectors, and what can be reached from each.
SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
l AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id AND list_cosine_similarity(x.e, y.e) >= 0.9),
r(id, x) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.id, l.b FROM r JOIN l ON r.x = l.a)
SELECT id AS vec_id, (SELECT count(*) FROM l WHERE a = id) AS n_links, min(x) AS component_id, id = min(x) AS kept FROM r GROUP BY id
"""
