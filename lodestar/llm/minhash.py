"""Near-dedup by MinHash bands and odd sketches, confirmed on full shingle sets.

Equal sets are collapsed first. Bands of MinHash samples propose documents; the samples folded
into a parity bitmap (an odd sketch) estimate a pair's similarity from the population count of the
XOR, and pairs that cannot reach the threshold are dropped. What is left joins documents into
loose groups, each of which gets its full sets once and is linked exactly, pair by pair, except
where both are already known to be reachable from each other.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .buffers import mixed, shingles, spans, starts_of, whole_groups
from .common import components, drop_written, only, small_batches, written

#: Samples are BANDS x ROWS; bits of the odd sketch; most rows whose pairs are all estimated, or all confirmed, in one task.
BANDS, ROWS, BITS, BLOCK, EXACT = 32, 5, 512, 1024, 256
#: Largest population count of a pair that may reach 0.8: five deviations of 160 samples, and of the folding, beyond it.
PLAUSIBLE = 112

_rng = np.random.default_rng(97)
_A = _rng.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_SALT = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def samples(s: np.ndarray) -> np.ndarray:
    """MinHash samples of a set of hashes."""
    low = np.full(len(_A), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(s), 1024):
        low = np.minimum(low, (s[None, at : at + 1024] * _A[:, None] + _B[:, None]).min(1))
    return low


def sketch(low: np.ndarray) -> np.ndarray:
    """The samples' parity bitmap."""
    at = mixed(low ^ _SALT) % np.uint64(BITS)
    return np.packbits(np.bincount(at.astype(np.int64), minlength=BITS) & 1 == 1)


def band_keys(low: np.ndarray) -> np.ndarray:
    rows = low.reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        key = mixed(key * np.uint64(0xD6E8FEB86659FD93) + rows[:, k])
    return key.view(np.int64)


def signatures(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(id, n, same, sketch, bands): the set's size, its digest, odd sketch and band keys."""
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            n, same, bits, bands = [], [], [], []
            for _, _, data, offsets in spans(batch.column(1)):
                for s in shingles(data, offsets, width):
                    n.append(len(s))
                    low = samples(s) if len(s) else None
                    same.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                    bits.append(sketch(low).tobytes() if len(s) else None)
                    bands.append(band_keys(low) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(same, pa.binary()), pa.array(bits, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names=["id", "n", "same", "sketch", "bands"])

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    return docs.select(f"`{id_col}`", f"`{text_col}`").mapInArrow(run, f"id {kind}, n long, same binary, sketch binary, bands array<long>")


def labelled(n: int, near) -> np.ndarray:
    """The smallest row reachable from each of n rows; near(i) marks the rows before i that i is linked with."""
    labels = np.arange(n)
    for i in range(1, n):
        found = labels[:i][near(i)]
        if len(found):
            found = np.unique(found)
            labels[i] = found[0]
            for x in found[1:]:
                labels[labels == x] = found[0]
    return labels


def _bits(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, BITS // 64)


def _loose(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(bucket, a, b, sketch): for every member of each bucket (or part of one) the member b that its sketch leads to, itself if none; sketch is b's own where a is b."""

    def run(batches):
        for table in whole_groups(batches, keys):
            at, ids = starts_of(table, keys), table.column("id").to_numpy()
            bits, roots = _bits(table.column("sketch")), np.arange(table.num_rows)
            for a, b in zip(at, at[1:]):
                own_bits = bits[a:b]
                roots[a:b] = a + labelled(b - a, lambda i, x=own_bits: np.bitwise_count(x[:i] ^ x[i]).sum(1) <= PLAUSIBLE)
            heads = pa.array(roots == np.arange(table.num_rows))
            sketches = pc.if_else(heads, table.column("sketch").combine_chunks(), pa.scalar(None, pa.binary()))
            yield pa.RecordBatch.from_arrays([table.column("bucket").combine_chunks(), pa.array(ids), pa.array(ids[roots]), sketches], names=["bucket", "a", "b", "sketch"])

    return rows.repartition(*keys).sortWithinPartitions(*keys).select(*keys, "id", "sketch").mapInArrow(run, "bucket long, a long, b long, sketch binary")


def confirmed(ids: np.ndarray, known: np.ndarray, bits: np.ndarray, sets: list[np.ndarray], least: int) -> np.ndarray:
    """The position of the root of every row: rows of equal id or known component, and rows whose sets are near enough."""
    n = len(ids)
    labels = np.arange(n)
    for same in (ids, known):
        _, first, inverse = np.unique(same, return_index=True, return_inverse=True)
        for i in np.flatnonzero(first[inverse] != np.arange(n)).tolist():
            _join(labels, i, int(first[inverse[i]]))
    sizes = np.array([len(s) for s in sets])
    for i in range(1, n):
        far = np.bitwise_count(bits[:i] ^ bits[i]).sum(1)
        small, large = np.minimum(sizes[:i], sizes[i]), np.maximum(sizes[:i], sizes[i])
        near = np.flatnonzero((far <= PLAUSIBLE) & (100 * small >= least * large) & (labels[:i] != labels[i]))
        near = near[np.argsort(far[near], kind="stable")]
        while len(near):
            j = int(near[0])
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if 100 * both >= least * (sizes[i] + sizes[j] - both):
                _join(labels, i, j)
                near = near[labels[near] != labels[i]]
            else:
                near = near[1:]
    return labels


def _join(labels: np.ndarray, i: int, j: int) -> None:
    x, y = labels[i], labels[j]
    if x != y:
        labels[labels == max(x, y)] = min(x, y)


def _exact(rows: DataFrame, keys: list[str], width: int, least: int) -> DataFrame:
    """Edges (a, b) that connect what is linked inside each group of rows (keys, id, known, text)."""

    def run(batches):
        for table in whole_groups(batches, keys):
            at, ids, known = starts_of(table, keys), table.column("id").to_numpy(), table.column("known").to_numpy()
            found, sets = [], []
            for chunk in table.column("text").chunks:
                for _, _, data, offsets in spans(chunk):
                    sets += shingles(data, offsets, width)
            bits = np.stack([sketch(samples(s)) for s in sets]).view(np.uint64)
            for a, b in zip(at, at[1:]):
                roots = confirmed(ids[a:b], known[a:b], bits[a:b], sets[a:b], least)
                own = np.flatnonzero(ids[a:b] != ids[a + roots])
                found += zip(ids[a + own], ids[a + roots[own]])
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], names=["a", "b"])

    return rows.repartition(*keys).sortWithinPartitions(*keys, "id").select(*keys, "id", "known", "text").mapInArrow(run, "a long, b long")


def _blocks(rows: DataFrame, groups: DataFrame, width: int, least: int) -> DataFrame:
    """Edges that link groups of any size exactly, in blocks of some EXACT rows.

    First inside blocks; then among the smallest rows of the blocks' components, in blocks of their
    own, dealt anew as long as that leaves a tenth fewer of them. Components other than a group's
    largest then meet every block; pairs inside the largest need no confirming.
    """
    spread = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.greatest(F.lit(1), F.ceil(n / EXACT)).cast("int"))
    rows = rows.join(groups, "loose").withColumn("block", spread(F.col("rows"), 5))
    edges = written(_exact(rows.withColumn("known", F.col("id")), ["loose", "block"], width, least), "edges")
    large = rows.where(F.col("rows") > EXACT)
    if large.isEmpty():
        return edges

    def with_labels(frame: DataFrame) -> DataFrame:
        found = components(edges)
        return frame.join(found, frame.id == found.node, "left").withColumn("known", F.coalesce("component", "id")).drop("node", "component")

    before, salt = None, 8
    while True:
        heads = written(with_labels(large.select("id", "loose")).where("known = id").select("id", "loose", "known"), "heads")
        several = heads.groupBy(F.col("loose").alias("l")).agg(F.count("*").alias("heads")).where("heads > 1")
        n = several.agg(F.sum("heads")).first()[0] or 0
        if not n or before is not None and n > 0.9 * before:
            break
        dealt = heads.join(several, F.col("loose") == F.col("l")).withColumn("part", spread(F.col("heads"), salt)).select(F.col("id").alias("i"), "known", "part")
        texts = only(large.select("id", "loose", "text"), dealt, "id", "i").drop("i")
        edges = written(edges.union(_exact(texts, ["loose", "part"], width, least)), "edges")
        before, salt = n, salt + 1
    now = written(with_labels(large), "labelled")
    sizes = now.groupBy("loose", "known").count()
    top = sizes.groupBy("loose").agg(F.max_by("known", F.struct("count", "known")).alias("top"), (F.sum("count") - F.max("count")).alias("others"))
    now = now.join(top, "loose").where("others > 0")
    parts = F.ceil(F.col("others") / EXACT).cast("int")
    blocks = F.greatest(F.lit(1), F.ceil(F.col("rows") / EXACT)).cast("int")
    own = now.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    other = now.where("known <> top").withColumn("part", F.pmod(F.xxhash64("id", F.lit(7)), parts)).withColumn("own", F.col("block"))
    other = other.withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1))).where("block <> own").drop("own")
    last = written(_exact(own.unionByName(other), ["loose", "block", "part"], width, least), "edges")
    drop_written(now)
    return edges.union(last)


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, least: int = 80) -> DataFrame:
    """One row for each row of docs: id, n_shingles, component_id, kept.

    Words are `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z; a set holds the distinct runs of `width`
    words, or all words as one run where there are fewer. Rows are linked when 100 * intersection is
    at least `least` * union; component_id is the smallest id reachable. Null, empty and blank
    texts have no shingles and stand alone, as do rows of null id, whose component is null and which
    are kept. Rows of equal id are one node. Texts of any length are read whole. Other columns of
    docs are not read; an empty table gives an empty result. `least` must be 80 or more, for which the bands and sketches are made.
    """
    if least < 80:
        raise ValueError("the bands are made for similarities of 0.8 or more")
    signed = written(signatures(docs, id_col, text_col, width), "signed")
    classes = signed.where("n > 0 AND id IS NOT NULL").groupBy("same").agg(F.min("id").alias("rep"))
    reps = signed.join(classes.hint("rebalance").withColumnRenamed("same", "s"), (F.col("same") == F.col("s")) & (F.col("id") == F.col("rep"))).select("id", "same", "sketch", "bands").dropDuplicates(["id", "same"])
    reps = written(reps, "reps")
    banded = reps.select("id", F.explode("bands").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1").hint("rebalance")
    met = written(banded.join(shared.withColumnRenamed("bucket", "b"), F.col("bucket") == F.col("b")).select("bucket", "id", "members"), "met")
    blocks = F.pmod(F.xxhash64("id", F.lit(3)), F.ceil(F.col("members") / BLOCK).cast("int"))
    drawn = met.withColumn("block", blocks).join(reps.select(F.col("id").alias("i"), "sketch"), F.col("id") == F.col("i")).select("bucket", "block", "id", "members", "sketch")
    first = written(_loose(drawn, ["bucket", "block"]), "sketched")
    # what leads the blocks of a large bucket is compared once more; where that is too many, all are one group, which the exact stage parts again
    leading = first.join(shared.where(F.col("members") > BLOCK).select(F.col("bucket").alias("k")), F.col("bucket") == F.col("k"), "left_semi").where("a = b")
    many = leading.groupBy(F.col("bucket").alias("k")).agg(F.count("*").alias("n"), F.min("a").alias("least")).hint("rebalance")
    leading = leading.join(many, F.col("bucket") == F.col("k"))
    second = _loose(leading.where(F.col("n") <= BLOCK).select("bucket", F.col("a").alias("id"), "sketch"), ["bucket"])
    star = leading.where(F.col("n") > BLOCK).select("a", F.col("least").alias("b"))
    pairs = first.select("a", "b").union(second.select("a", "b")).union(star).where("a <> b")
    loose = written(components(pairs).select(F.col("node").alias("rep"), F.col("component").alias("loose")), "loose")
    groups = loose.groupBy("loose").agg(F.count("*").alias("rows"))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    members = written(only(texts, loose, "id", "rep").select("id", "loose", "text"), "members")
    # an id with several texts ties their classes together
    several = signed.where("n > 0 AND id IS NOT NULL").groupBy(F.col("id").alias("a")).agg(F.min("same").alias("x"), F.max("same").alias("y")).where("x <> y").select("a")
    ties = signed.where("n > 0").join(several, F.col("id") == F.col("a")).join(classes, "same").select("a", F.col("rep").alias("b"))
    found = components(_blocks(members, groups, width, least).union(ties)).withColumnRenamed("node", "rep")
    drop_written(members)
    linked = classes.join(found, "rep", "left").select(F.col("same").alias("s"), F.coalesce("component", "rep").alias("component")).hint("rebalance")
    out = signed.join(linked, F.col("same") == F.col("s"), "left")
    mine = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), mine.alias("component_id"), F.col("id").eqNullSafe(mine).alias("kept"))


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay: one of each near-duplicate group."""
    gone = near_dedup(docs, id_col, text_col).where("NOT kept").select(F.col(id_col).alias("__gone"))
    return docs.join(gone, F.col(id_col) == F.col("__gone"), "left_anti")


def op4_minhash(spark, sf_dir: str) -> DataFrame:
    return near_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), width=4)


#: All pairs that share a shingle, and what can be reached from each document.
SQL = """
WITH RECURSIVE t AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM t WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y USING (g) WHERE x.doc_id <> y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
r(id, x) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.id, l.b FROM r JOIN l ON r.x = l.a)
SELECT id AS doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(x) AS component_id, id = min(x) AS kept FROM r LEFT JOIN n ON n.doc_id = id GROUP BY id
"""
