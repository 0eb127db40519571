"""Language identification as inference of a multilingual mixture.

A document is a bag of byte trigrams, each drawn from one of the learned languages. Expectation
maximisation estimates the document's proportions; the set of languages grows by the one that fits
best, and the set of highest likelihood less a penalty for each language in it is chosen. The
prediction is its largest member, the score that language's proportion in the set.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .buffers import spans
from .common import small_batches

#: Places of hashed trigrams; labelled documents learned from, for each language; EM steps; cost of a language in a set, times log(n).
PLACES, SAMPLE, STEPS, COST = 1 << 16, 1500, 8, 2.0
#: Long texts are counted in parts of so many bytes.
PART = 4_000_000

#: Letters are folded, other ASCII bytes become a space; bytes of longer characters stay.
_TABLE = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint8)


def _grams(data: np.ndarray) -> np.ndarray:
    """Hashed trigrams of bytes."""
    d = data.astype(np.uint32)
    g = (d[:-2] << np.uint32(16)) | (d[1:-1] << np.uint32(8)) | d[2:]
    g *= np.uint32(0x9E3779B1)
    g >>= np.uint32(16)
    return g


def _bags(data: np.ndarray, offsets: np.ndarray):
    """(row, gram, count) of every row's trigrams, with a space before and after a text; sorted by row."""
    n = len(offsets) - 1
    if n == 1 and len(data) > PART:
        bag = np.zeros(PLACES, np.int64)
        space = np.array([32], np.uint8)
        for at in range(0, len(data), PART):  # the places of a part's trigrams in the text with its spaces
            part = _TABLE[data[max(0, at - 1) : at + PART + 1]]
            part = np.concatenate((space[: at == 0], part, space[: at + PART + 1 > len(data)]))
            bag += np.bincount(_grams(part), minlength=PLACES)
        gram = np.flatnonzero(bag)
        return np.zeros(len(gram), np.int64), gram, bag[gram]
    lengths = np.diff(offsets)
    padded = np.full(len(data) + 2 * n, 32, np.uint8)
    row = np.repeat(np.arange(n), lengths + 2)
    padded[np.arange(len(data)) + np.repeat(2 * np.arange(n) + 1, lengths)] = _TABLE[data]
    if len(padded) < 3:
        return (np.empty(0, np.int64),) * 3
    same = row[:-2] == row[2:]
    keys = (row[:-2][same].astype(np.uint64) << np.uint64(16)) | _grams(padded)[same]
    keys.sort()
    at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, np.int64)
    keys, count = keys[at], np.diff(np.append(at, len(keys)))
    return (keys >> np.uint64(16)).astype(np.int64), (keys & np.uint64(PLACES - 1)).astype(np.int64), count


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Languages, and log-probabilities of trigrams by language (float32).

    Learns from about `sample` documents of each language, chosen by a hash of the id and the
    checksum of the text, and from all of them where there are fewer. Rows of null language or
    text are left out. The driver gets a count for each language and hashed trigram, no texts.
    """
    known = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = {r[0]: r[1] for r in known.groupBy(lang_col).count().collect()}
    langs = sorted(sizes)
    if not langs:
        return [], np.zeros((0, PLACES), np.float32)
    scale = 1 << 30
    below = F.create_map(*[F.lit(x) for l in langs for x in (l, int(scale * min(1.0, sample / sizes[l])))])
    chosen = known.where(F.pmod(F.xxhash64(id_col, F.crc32(F.col(text_col).cast("binary"))), F.lit(scale)) < below[F.col(lang_col)])
    small_batches(labelled.sparkSession)

    def run(batches):
        for batch in batches:
            of = batch.column(0).to_pylist()
            for lo, hi, data, offsets in spans(batch.column(1)):
                row, gram, count = _bags(data, offsets)
                lang = np.array([langs.index(x) for x in of[lo:hi]])
                bag = np.bincount(lang[row] * PLACES + gram, weights=count, minlength=len(langs) * PLACES)
                at = np.flatnonzero(bag)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(bag[at].astype(np.int64))], names=["at", "n"])

    counts = chosen.select(lang_col, text_col).mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    bag = np.zeros(len(langs) * PLACES)
    bag[counts["at"].to_numpy()] = counts["n"].to_numpy()
    bag = bag.reshape(len(langs), PLACES) + 0.05
    return langs, np.log(bag / bag.sum(1, keepdims=True)).astype(np.float32)


def _mixture(p: np.ndarray, count: np.ndarray, starts: np.ndarray, row: np.ndarray, pi: np.ndarray, steps: int):
    """Proportions by row after EM from pi, and the log-likelihood (less the constant of each gram)."""
    total = np.add.reduceat(count, starts)[:, None]
    for _ in range(steps):
        r = p * pi[row]
        r *= (count / np.maximum(r.sum(1), 1e-30))[:, None]
        pi = np.add.reduceat(r, starts) / total
    fit = np.log(np.maximum((p * pi[row]).sum(1), 1e-30))
    return pi, np.add.reduceat(fit * count, starts)


def infer(row: np.ndarray, gram: np.ndarray, count: np.ndarray, logp: np.ndarray, n: int):
    """(language number or -1, proportion) of each of n rows; a row without grams has none."""
    best, share = np.full(n, -1), np.zeros(n)
    if not len(row) or not len(logp):
        return best, share
    starts = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
    rows, inner, k = row[starts], np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(row)))), len(logp)
    lp, count = logp[:, gram].T, count.astype(np.float32)
    p = np.exp(lp - lp.max(1, keepdims=True))
    tops = np.log(np.maximum(p, 1e-30)) * count[:, None]
    single = np.add.reduceat(tops, starts)
    _, fit = _mixture(p, count, starts, inner, np.full((len(starts), k), 1 / k, np.float32), STEPS)
    cost = COST * np.log(np.maximum(np.add.reduceat(count, starts), 2))
    chosen, score, part = single.argmax(1), single.max(1) - cost, np.ones(len(starts))
    # no set can fit better than all languages do: only rows in which two might win are looked at further
    open_ = np.flatnonzero(fit - 2 * cost > score)
    member = np.zeros((len(starts), k), bool)
    member[np.arange(len(starts)), chosen] = True
    for size in range(2, k + 1):
        if not len(open_):
            break
        keep = np.zeros(len(starts), bool)
        keep[open_] = True
        sel = keep[inner]
        sub = np.cumsum(keep)[inner[sel]] - 1
        edges = np.flatnonzero(np.concatenate(([True], sub[1:] != sub[:-1])))
        # the set grows by the language that makes it fit best
        fits, mixes, added = np.full(len(open_), -np.inf), np.zeros((len(open_), k)), np.zeros(len(open_), int)
        for j in range(k):
            sets = member[open_] | (np.arange(k) == j)
            mix, f = _mixture(p[sel], count[sel], edges, sub, (sets / sets.sum(1, keepdims=True)).astype(np.float32), STEPS)
            f = np.where(member[open_, j], -np.inf, f)
            better = f > fits
            fits[better], mixes[better], added[better] = f[better], mix[better], j
        member[open_, added] = True
        better = fits - size * cost[open_] > score[open_]
        at = open_[better]
        score[at], chosen[at], part[at] = (fits - size * cost[open_])[better], mixes[better].argmax(1), mixes[better].max(1)
        open_ = open_[fit[open_] - (size + 1) * cost[open_] > score[open_]]
    best[rows], share[rows] = chosen, np.clip(part, 0, 1)
    return best, share


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score, from whole texts alone.

    `und` with score 0 where the text is null, empty or has no letter, or nothing was learned. The
    score is the language's estimated share of the document within the chosen set: 1 where that is one
    language. Texts of any length are read whole. Columns of docs with these names, in
    any case, are replaced. Repeated rows get equal results; an empty table gives an empty one.
    """
    from .common import without

    docs = without(docs, ["lang_pred", "score"])
    small_batches(docs.sparkSession)
    langs, logp = model
    shared = docs.sparkSession.sparkContext.broadcast(np.ascontiguousarray(logp))
    at = docs.columns.index(text_col)

    def run(batches):
        logp = shared.value
        for batch in batches:
            pred, score = np.full(batch.num_rows, -1), np.zeros(batch.num_rows)
            texts = batch.column(at)
            for lo, hi, data, offsets in spans(texts):
                best, share = infer(*_bags(data, offsets), logp, hi - lo)
                letters = ((data | 32) >= 97) & ((data | 32) <= 122)
                seen = np.concatenate(([0], np.cumsum(letters)))
                has = np.diff(seen[offsets]) > 0
                for i in np.flatnonzero(~has):
                    has[i] = any(map(str.isalpha, texts[lo + int(i)].as_py() or ""))
                pred[lo:hi], score[lo:hi] = np.where(has, best, -1), np.where(has, share, 0)
            names = [langs[i] if i >= 0 else "und" for i in pred]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(np.where(pred >= 0, score, 0.0))], names=[*batch.schema.names, "lang_pred", "score"])

    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    schema = StructType([*docs.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return docs.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id"):
    """The fold that nothing is learned from."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def contract_model(docs: DataFrame):
    return train(docs.where(~held_out()))


def op6_langid(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(docs.select("doc_id", "text"), contract_model(docs.select("doc_id", "text", "lang")))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
