"""Best-fit packing of token sequences by hierarchical residual packing.

Every partition packs its pieces where they are, best-fit, largest first. Bins that are nearly full are final; the
others go on as items to a coarser level, where the bins of several groups meet and are packed
again, and so on up a tree. A level has as many groups as keep each under GROUP items, and the
tree ends when a level joins almost nothing more, so no task ever holds more than GROUP items.
"""

from __future__ import annotations

import zlib
from array import array
from bisect import bisect_left, insort
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, written
from .words import AT_ONCE, Memory, flat, together, token_ids

#: Most items that one task packs, and the share of them by which a level must shrink to be followed by another.
GROUP, LEAST = 100_000, 0.002


@lru_cache(1)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


def _opening(own) -> np.ndarray:
    """Whether a token starts with a space, by id."""
    vocabulary = own.get_vocab()
    out = np.zeros(max(vocabulary.values()) + 1, bool)
    out[[i for token, i in vocabulary.items() if token[0] == "\u0120"]] = True
    return out


def _byte_symbols() -> list[str]:
    """The symbol of every byte in byte-level vocabularies: printable bytes stand for themselves, the others follow from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


_SYMBOLS = dict(enumerate(_byte_symbols()))
_SPACE = _SYMBOLS[32]
@lru_cache(1)
def _plain(own):
    """own for text in byte symbols whose pre-tokens start with a space."""
    from tokenizers import Tokenizer, pre_tokenizers

    t = Tokenizer.from_str(own.to_str())
    t.encode_special_tokens = True
    t.pre_tokenizer = pre_tokenizers.Split(_SPACE, "merged_with_next")
    return t


def _word_ids(own, opens: np.ndarray, words: list[str], together: int = 200):
    """(word, its ids after a space as bytes).

    Words without white space at their ends are encoded many at a time, with a space before each: a
    token starts with a space where a word does and nowhere else.
    """
    joined, alone = [], []
    for w in words:
        (joined if w and not w[0].isspace() and not w[-1].isspace() and " " not in w else alone).append(w)
    groups = [joined[i : i + together] for i in range(0, len(joined), together)]
    for group, e in zip(groups, own.encode_batch_fast([" " + " ".join(g) for g in groups], add_special_tokens=False)):
        ids = array("I", e.ids)
        at = np.flatnonzero(opens[np.frombuffer(ids, "<u4")]).tolist()
        if len(at) != len(group):
            alone += group
            continue
        raw = ids.tobytes()
        yield from zip(group, [raw[4 * a : 4 * b] for a, b in zip(at, [*at[1:], len(ids)])])
    yield from zip(alone, [array("I", e.ids).tobytes() for e in own.encode_batch_fast([" " + w for w in alone], add_special_tokens=False)])


class HubMemory(Memory):
    """Words encoded by a tokenizer of the `tokenizers` library."""

    def __init__(self, own):
        self.own, self.opens = own, _opening(own)
        super().__init__()

    def whole(self, texts: list[str]) -> list:
        return [e.ids for e in self.own.encode_batch_fast(texts, add_special_tokens=False)]

    def others(self, words: list[str]) -> list:
        raw = dict(_word_ids(self.own, self.opens, words))
        return [array("I", raw[w]) for w in words]

    def letters(self, keys: pa.Array, together: int = 200) -> tuple[np.ndarray, np.ndarray]:
        """Words of letters are one pre-token each: they go to the merges in byte symbols, many at a time."""
        edges = [*range(0, len(keys), together), len(keys)]
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(edges, pa.int32()), keys), pa.scalar(" ", keys.type)).to_pylist()
        found = _plain(self.own).encode_batch_fast([(" " + t).encode().decode("latin-1").translate(_SYMBOLS) for t in joined], add_special_tokens=False)
        ids, _ = flat([e.ids for e in found])
        at = np.flatnonzero(self.opens[ids])
        if len(at) != len(keys):
            raise ValueError("the vocabulary has tokens with a space after their start")
        return ids, np.diff(at, append=len(ids))


def pieces(docs: DataFrame, capacity: int, end_id: int, vocabulary: str | None, id_col: str, text_col: str) -> DataFrame:
    """(__id, piece, start, length, ids_crc32) of every document's ids and its end."""
    small_batches(docs.sparkSession, 64)

    def run(batches):
        import os

        import public_tokenizers as public

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        memory = HubMemory(_tokenizer(vocabulary or public.path("byte_bpe_50k.json")))
        for batch in together(batches, AT_ONCE):
            ids, bounds = token_ids(batch.column(1), memory)
            bounds = bounds + np.arange(len(bounds))  # with an end each
            ids = np.insert(ids, bounds[1:] - np.arange(1, len(bounds)), np.uint32(end_id)).astype("<u4")
            lengths = np.diff(bounds)
            count = -(-lengths // capacity)
            row = np.repeat(np.arange(len(lengths)), count)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            first = lengths - (count - 1) * capacity  # the first piece may be shorter
            start = np.where(nth == 0, 0, first[row] + (nth - 1) * capacity)
            length = np.where(nth == 0, first[row], capacity)
            at = bounds[row] + start
            sums = [zlib.crc32(ids[a:b]) for a, b in zip(at.tolist(), (at + length).tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(nth, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(sums, pa.int64())], names=["__id", "piece", "start", "length", "ids_crc32"])
        # the worker lives on, and other stages need its memory
        del memory
        pa.default_memory_pool().release_unused()

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    return docs.select(f"`{id_col}`", f"`{text_col}`").mapInArrow(run, f"__id {kind}, piece int, start long, length long, ids_crc32 long")


def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each size: largest first, into the fullest bin with room."""
    rooms: list[int] = []  # sorted rooms that some bin has
    bins: dict[int, list[int]] = {}  # by room
    out, made = np.empty(len(sizes), np.int64), 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        at = bisect_left(rooms, size)
        if at == len(rooms):
            b, room, made = made, capacity, made + 1
        else:
            room = rooms[at]
            b = bins[room].pop()
            if not bins[room]:
                del bins[room], rooms[at]
        out[i] = b
        if left := room - size:
            if left not in bins:
                bins[left] = []
                insort(rooms, left)
            bins[left].append(b)
    return out


def _packed(pdf: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """Items (item, size) with their bin, named by its largest item, and its fill."""
    pdf = pdf.sort_values(["size", "item"], ascending=[False, True])
    nth = best_fit(pdf["size"].to_numpy(), capacity)
    first = pdf["item"].to_numpy()[np.unique(nth, return_index=True)[1]]
    fill = np.bincount(nth, weights=pdf["size"]).astype(np.int64)
    return pd.DataFrame({"item": pdf["item"], "size": pdf["size"], "bin": first[nth], "fill": fill[nth]})


def _local(items: DataFrame, capacity: int) -> DataFrame:
    """The first level: items are packed where they are, GROUP / 8 at a time, without a shuffle."""

    def run(batches):
        held, n = [], 0
        for pdf in batches:
            held.append(pdf)
            n += len(pdf)
            if n >= GROUP // 8:
                yield _packed(pd.concat(held), capacity)
                held, n = [], 0
        if n:
            yield _packed(pd.concat(held), capacity)

    return items.mapInPandas(run, "item long, size long, bin long, fill long")


def _level(items: DataFrame, groups: int, capacity: int, level: int) -> DataFrame:
    """A further level: the bins of several groups meet."""
    group = F.pmod(F.xxhash64("item", F.lit(level)), F.lit(groups))
    return items.groupBy(group.alias("g")).applyInPandas(lambda pdf: _packed(pdf, capacity), "item long, size long, bin long, fill long")


def pack(docs: DataFrame, capacity: int = 1024, end_id: int = 2, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text", slack: int = 1) -> DataFrame:
    """One row for each piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is the end id alone. Only documents over the capacity are cut; their first
    piece may be shorter. Repeated rows are packed each on its own, also with equal or null ids. A
    bin with at most `slack` tokens of room is final. Texts of any length are read whole. An empty
    table gives an empty result; other columns of docs are not read.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    rows = written(pieces(docs, capacity, end_id, vocabulary, id_col, text_col).withColumn("item", F.monotonically_increasing_id()), "pieces")
    whole = rows.where(F.col("length") == capacity)
    live = rows.where(F.col("length") < capacity).select("item", F.col("length").alias("size"))
    n, final, chain = live.count(), [], live.select(F.col("item").alias("leaf"), "item")
    level = 0
    while n > 0:
        groups = max(1, -(-n // GROUP)) if level else 0
        packed = written(_level(live, groups, capacity, level) if level else _local(live, capacity), "bins")
        chain = written(chain.join(packed.select("item", "bin", "fill"), "item").select("leaf", F.col("bin").alias("item"), "fill"), "chain")
        done = F.col("fill") >= capacity - slack
        bins = packed.select(F.col("bin").alias("item"), F.col("fill").alias("size")).distinct()
        left = bins.where(F.col("size") < capacity - slack)
        m = left.count()
        final.append(chain.where(done).select("leaf", F.col("item").alias("sequence_id")))
        chain = chain.where(~done)
        if groups == 1 or level and m > (1 - LEAST) * n:
            final.append(chain.select("leaf", F.col("item").alias("sequence_id")))
            break
        chain, live, n, level = chain.select("leaf", "item"), left, m, level + 1
    found = whole.select("item", F.col("item").alias("sequence_id"))
    for f in final:
        found = found.union(f)
    over = Window.partitionBy("sequence_id").orderBy(F.col("length").desc(), "item")
    packed = rows.join(found.withColumnRenamed("item", "leaf"), F.col("item") == F.col("leaf")).drop("leaf")
    return packed.withColumn("offset", F.sum("length").over(over) - F.col("length")).select(F.col("__id").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op10_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
