"""Merkle manifest of a dataset: a root over groups of rows, and a proof of every row.

A leaf is the hash of a row's fields. Leaves of a group are numbered in order; a level groups the
numbers by number div FANOUT, and the hash of a group's children, in order, is its parent. Levels
are DataFrames, each an eighth of the one before, written to the shared folder; groups that have come
to one node wait as subroots, and the subroots are a tree of the same kind. Proofs are made from the
top down: a level's groups are joined with the paths of their parents, and every child appends its
own siblings. No step sees more than the children of one node at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, drop_written, written

FANOUT = 8
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
PATH = "array<struct<left:string,right:string>>"


def encoded(value):
    """A field of a leaf: `-` if null, else its bytes' number, a colon and the value."""
    s = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf_of(values: list):
    return F.sha2(F.concat(*[encoded(v) for v in values]), 256)


def tampered(doc_id, text):
    """The text as a forger leaves it: a third of all ids have A-Z lower-cased; null if untouched."""
    return F.when(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 0, F.translate(text, UPPER, LOWER))


def _numbered(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """leaves (grp, doc_id, leaf, forged) as (grp, i, n, h, doc_id, forged), and the table behind it: i is the number of a leaf in its group from 0, n the leaves of its group.

    Rows are dealt to ranges of (grp, doc_id, leaf) and sorted there; a leaf's number is its place in
    the range and what earlier ranges hold of its group.
    """
    at = F.monotonically_increasing_id()
    ranged = leaves.repartitionByRange("grp", "doc_id", "leaf").sortWithinPartitions("grp", "doc_id", "leaf").withColumn("__at", at)
    ranged = written(ranged.withColumn("__range", F.shiftright("__at", 33)), "ranges")
    own = ranged.groupBy(F.col("grp").alias("__g"), F.col("__range").alias("__r")).agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    group = Window.partitionBy("__g")
    own = own.select("__g", "__r", (F.sum("__n").over(group.orderBy("__r")) - F.col("__n") - F.col("__first")).alias("__shift"), F.sum("__n").over(group).alias("n"))
    numbered = ranged.join(own, (F.col("grp") == F.col("__g")) & (F.col("__range") == F.col("__r")))
    return numbered.select("grp", (F.col("__at") + F.col("__shift")).alias("i"), "n", F.col("leaf").alias("h"), "doc_id", "forged"), ranged


def _tree(leaves: DataFrame, extra: list[str]) -> tuple[list[DataFrame], DataFrame]:
    """(levels, tops): levels[k] has (grp, g, kids) of the groups that still had several nodes at level k; tops has (grp, h, level) of the nodes that remain.

    Children of level 0 carry the columns of extra.
    """
    nodes, ranged = _numbered(leaves)
    levels, tops, level = [], None, 0
    while True:
        done = nodes.where("n = 1").select("grp", "h", F.lit(level).alias("level"), *[c for c in extra if level == 0])
        done = done if level == 0 else done.select("*", *[F.lit(None).cast(tops.schema[c].dataType).alias(c) for c in extra])
        tops = done if tops is None else tops.unionByName(done)
        open_ = nodes.where("n > 1")
        kid = F.struct("i", "h", *[c for c in extra if level == 0])
        groups = open_.groupBy("grp", F.expr(f"i div {FANOUT}").alias("g")).agg(F.array_sort(F.collect_list(kid)).alias("kids"), F.first("n").alias("n"))
        groups = groups.withColumn("h", F.sha2(F.array_join(F.col("kids.h"), ""), 256))
        groups = written(groups, "level")
        if groups.isEmpty():
            tops = written(tops, "tops")
            drop_written(groups)
            drop_written(ranged)
            return levels, tops
        levels.append(groups)
        nodes = groups.select("grp", F.col("g").alias("i"), F.expr(f"(n + {FANOUT - 1}) div {FANOUT}").alias("n"), "h")
        level += 1


def _children(groups: DataFrame, paths: DataFrame, extra: list[str], carried: list[str]) -> DataFrame:
    """Every child of groups with its path: its own siblings, then the path of its parent."""
    above = paths.select(F.col("grp").alias("__grp"), F.col("i").alias("__i"), "path", *carried)
    met = groups.select("grp", "g", "kids").join(above, (F.col("grp") == F.col("__grp")) & (F.col("g") == F.col("__i")))
    kid = met.select("grp", F.posexplode("kids").alias("__pos", "kid"), F.col("kids.h").alias("hs"), "path", *carried)
    side = lambda first, count: F.array_join(F.slice("hs", first, count), "")
    own = F.struct(side(F.lit(1), F.col("__pos")).alias("left"), side(F.col("__pos") + 2, F.lit(FANOUT)).alias("right"))
    return kid.select("grp", "kid.i", "kid.h", *[f"kid.{c}" for c in extra], F.concat(F.array(own), "path").alias("path"), *carried)


def _paths(levels: list[DataFrame], tops: DataFrame, extra: list[str], carried: list[str]) -> DataFrame:
    """(grp, i, h, path) and extra of every node of level 0; tops: (grp, h, level, path) and what all nodes of a group carry from it."""
    at = lambda level: tops.where(F.col("level") == level).select("grp", F.lit(0).cast("long").alias("i"), "h", *[c for c in extra if level == 0], "path", *carried)
    nodes = at(len(levels))
    for level in range(len(levels) - 1, -1, -1):
        nodes = _children(levels[level], nodes, extra if level == 0 else [], carried).unionByName(at(level))
    return nodes


def folded(leaf, path):
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))


def manifest(docs: DataFrame, forge=tampered) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row of docs (doc_id, source, lang, n_chars, text).

    forge(doc_id, text) gives the text that is put in place of a row's own when it is checked, or
    null. Null fields are `-`, an empty text is `0:`; a null lang is a group of its own, the first.
    In a group a null doc_id comes first, and rows of equal id are in the order of their leaves, so
    repeated rows have leaves of their own. A group of one row is its own subroot, one group its own
    root; without siblings the proof is the hash of nothing. An empty table gives no rows. Texts may
    be of any length; other columns of docs are not read.
    """
    field = {c: F.col(c) for c in FIELDS}
    false = forge(field["doc_id"], field["text"])
    leaves = docs.select(
        F.when(field["lang"].isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), "lang")).alias("grp"), "doc_id", leaf_of(list(field.values())).alias("leaf"),
        F.when(false.isNotNull(), leaf_of([*[field[c] for c in FIELDS[:-1]], false])).alias("forged"),
    )
    extra = ["doc_id", "forged"]
    leaves = written(leaves, "leaves")  # else texts are hashed once more, to find the ranges
    levels, tops = _tree(leaves, extra)
    drop_written(leaves)
    # subroots by group, numbered over ranges as leaves are
    heads = tops.select(F.lit("").alias("grp"), F.col("grp").alias("doc_id"), F.col("h").alias("leaf"), F.lit(None).cast("string").alias("forged"))
    upper, root = _tree(heads, ["doc_id"])
    above = _paths(upper, root.select("grp", "h", "level", "doc_id", F.array().cast(PATH).alias("path"), F.col("h").alias("root")), ["doc_id"], ["root"])
    above = above.select(F.col("doc_id").alias("__of"), "path", "root")
    tops = tops.join(above, F.col("grp") == F.col("__of")).drop("__of").withColumn("subroot", F.col("h"))
    rows = _paths(levels, tops, extra, ["subroot", "root"])
    proof = F.sha2(F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), ""), 256)
    out = rows.select("doc_id", F.col("h").alias("leaf"), "subroot", "root", proof.alias("proof_sha256"), folded(F.coalesce("forged", "h"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_merkle(spark, sf_dir: str) -> DataFrame:
    return manifest(spark.read.parquet(f"{sf_dir}/documents.parquet").select(*FIELDS))


def _sql(deep: int = 8) -> str:
    """So many levels below and above subroots: 8 ** 8 rows a group, beyond what is checked. The checksum is taken bit by bit."""
    enc = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c} END"
    leaf = lambda t: "sha256(" + " || ".join([enc(c) for c in FIELDS[:-1]] + [enc(t)]) + ")"
    bits = "flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda d: [ord(d)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))"
    crc = f"xor(list_reduce({bits}, lambda c, b: xor(xor(c, b) >> 1, CASE WHEN xor(c, b) & 1 = 1 THEN 3988292384 ELSE 0 END), 4294967295::BIGINT), 4294967295)"
    up = lambda of, g, l: f"{of}{l + 1} AS (SELECT {g} AS g, i // {FANOUT} AS i, CASE WHEN any_value(n) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h, list(h ORDER BY i) AS hs, any_value(n) > 1 AS more, (any_value(n) + {FANOUT - 1}) // {FANOUT} AS n FROM {of}{l} GROUP BY {g}, i // {FANOUT})"
    kids = lambda of, at, l: f"array_to_string({of}{l + 1}.hs[1 : w.{at} // {FANOUT**l} % {FANOUT}], '') AS {of}l{l}, array_to_string({of}{l + 1}.hs[w.{at} // {FANOUT**l} % {FANOUT} + 2 :], '') AS {of}r{l}, {of}{l + 1}.more AS {of}x{l}"
    every = range(deep)
    levels = ", ".join([up("a", "g", l) for l in every])
    upper = ", ".join([up("b", "g", l) for l in every])
    joins = " ".join([f"JOIN a{l + 1} ON a{l + 1}.g = w.g AND a{l + 1}.i = w.i // {FANOUT ** (l + 1)}" for l in every] + [f"JOIN b{l + 1} ON b{l + 1}.i = w.j // {FANOUT ** (l + 1)}" for l in every])
    steps = [("a", "i", l) for l in every] + [("b", "j", l) for l in every]
    fold = ", ".join(f"f{n + 1} AS (SELECT *, CASE WHEN {of}x{l} THEN sha256({of}l{l} || f{n}_ || {of}r{l}) ELSE f{n}_ END AS f{n + 1}_ FROM f{n})" for n, (of, _, l) in enumerate(steps))
    return f"""WITH t AS (SELECT *, CASE WHEN {crc} % 3 = 0 THEN translate(text, '{UPPER}', '{LOWER}') ELSE text END AS forged FROM documents),
a0 AS (SELECT coalesce('1' || lang, '0') AS g, doc_id, {leaf("text")} AS h, {leaf("forged")} AS f, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, {leaf("text")}) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM t),
{levels}, b0 AS (SELECT 1 AS g, g AS grp, h, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n FROM a{deep}), {upper},
w AS (SELECT a0.*, b0.i AS j, b0.h AS subroot FROM a0 JOIN b0 ON a0.g = b0.grp),
f0 AS (SELECT w.*, b{deep}.h AS root, w.f AS f0_, {", ".join(kids(of, at, l) for of, at, l in steps)} FROM w {joins}), {fold}
SELECT doc_id, h AS leaf, subroot, root, sha256({" || ".join(f"CASE WHEN {of}x{l} THEN {of}l{l} || {of}r{l} ELSE '' END" for of, _, l in steps)}) AS proof_sha256, f{2 * deep}_ AS folded_root, f{2 * deep}_ = root AS verified FROM f{2 * deep}"""


SQL = _sql()
