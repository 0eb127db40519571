"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier one is a minimal perfect hash over the vocabulary: n keys, n slots, one displacement for each
bucket of keys. A whole pre-token found in its slot is one id. Tier two, for misses, merges bytes
held in a doubly linked list, taking the lowest rank from a heap until no pair is in the vocabulary.
"""

from __future__ import annotations

import base64
import hashlib
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame

from .common import small_batches
from .words import AT_ONCE, Memory, filled, flat, together, token_ids

#: Keys a bucket of the perfect hash, on average; ids that are decoded and digested at once, unless one text alone has more.
A_BUCKET, DIGESTED = 3, 200_000


def _place(x: int, y: int, d: int) -> int:
    """A new place for each displacement d, from two halves of a key's hash."""
    z = (x ^ d * 0x9E3779B1) * y & 0xFFFFFFFFFFFFFFF
    return z ^ z >> 29


class PerfectHash:
    """Minimal perfect hash of distinct byte strings, by hashing and displacing buckets."""

    def __init__(self, keys: list[bytes]):
        n = self.n = len(keys)
        self.buckets = max(1, n // A_BUCKET)
        hashes = [xxhash.xxh3_64_intdigest(k) for k in keys]
        groups: dict[int, list[int]] = {}
        for i, h in enumerate(hashes):
            groups.setdefault(h % self.buckets, []).append(i)
        self.displaced = [0] * self.buckets
        slots, free = [-1] * n, None
        for b, members in sorted(groups.items(), key=lambda g: -len(g[1])):
            if len(members) == 1:  # any free slot does; negative numbers name it
                free = free or iter([i for i, k in enumerate(slots) if k < 0])
                at = next(free)
                self.displaced[b] = -at - 1
                slots[at] = members[0]
                continue
            pairs = [(hashes[i] >> 32, hashes[i] & 0xFFFFFFFF | 1) for i in members]
            d = 0
            while True:
                places = {_place(x, y, d) % n for x, y in pairs}
                if len(places) == len(pairs) and all(slots[p] < 0 for p in places):
                    break
                d += 1
            self.displaced[b] = d
            for i, (x, y) in zip(members, pairs):
                slots[_place(x, y, d) % n] = i
        self.slots = slots

    def slot(self, key: bytes) -> int:
        """The only slot in which key can be."""
        h = xxhash.xxh3_64_intdigest(key)
        d = self.displaced[h % self.buckets]
        return -d - 1 if d < 0 else _place(h >> 32, h & 0xFFFFFFFF | 1, d) % self.n


class Tokenizer:
    """Encodes text and decodes ids by the ranks of a vocabulary file."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, hash_: PerfectHash | None = None):
        keys = list(ranks)
        self.ranks = ranks
        self.hash = hash_ or PerfectHash(keys)
        self.keys = [keys[i] for i in self.hash.slots]
        self.ids = [ranks[k] for k in self.keys]
        self.split = regex.compile(pattern).findall
        top = max(ranks.values(), default=0) + 1
        words = [b""] * top
        for k, i in ranks.items():
            words[i] = k
        #: Bytes of every id, and its decimal digits after a space.
        self.words, self.shown = Table(words), Table([b" %d" % i for i in range(top)])

    def token(self, token: bytes) -> tuple:
        """Ids of one pre-token."""
        at = self.hash.slot(token)
        if at >= 0 and self.keys[at] == token:
            return (self.ids[at],)
        return self.merged(token)

    def merged(self, token: bytes) -> tuple:
        """Lowest rank first, leftmost among equals, over linked bytes."""
        n, rank = len(token), self.ranks.get
        if n < 2:
            return tuple(self.ranks[token[i : i + 1]] for i in range(n))
        after, before, ends = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(token[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            _, i, end = heappop(heap)
            if ends[i] < 0 or (j := after[i]) >= n or ends[j] != end:
                continue  # one of the two has since been merged
            ends[i], ends[j], after[i] = end, -1, after[j]
            if (k := after[i]) < n:
                before[k] = i
                if (r := rank(token[i : ends[k]])) is not None:
                    heappush(heap, (r, i, ends[k]))
            if (k := before[i]) >= 0 and (r := rank(token[k:end])) is not None:
                heappush(heap, (r, k, end))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[token[i : ends[i]]])
            i = after[i]
        return tuple(out)

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(self.token(t.encode("utf-8", "replace")) for t in self.split(text)))

    def decode(self, ids) -> bytes:
        return self.words.joined(np.asarray(ids, np.int64))[0].tobytes()


class Table:
    """Byte strings by number."""

    def __init__(self, strings: list[bytes]):
        self.length = np.array([len(x) for x in strings], np.int64)
        self.begin = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(strings), np.uint8)

    def joined(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The strings of some numbers, one after another, and where each starts and the last ends."""
        length = self.length[numbers]
        edge = np.concatenate(([0], np.cumsum(length)))
        out = np.empty(edge[-1], np.uint8)
        filled(out, edge[:-1], self.bytes, self.begin[numbers], length)
        return out, edge


class BpeMemory(Memory):
    """Words encoded by a Tokenizer: what the memory has not met goes to the perfect hash, and then to the heap."""

    def __init__(self, own: Tokenizer):
        self.own = own
        super().__init__()

    def whole(self, texts: list[str]) -> list:
        return list(map(self.own.encode, texts))

    def letters(self, keys: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """A word of letters after a space is one pre-token."""
        return flat([self.own.token(b" " + w.encode()) for w in keys.to_pylist()])


_hashes: dict = {}


def _ranks(path: str | None) -> tuple[dict[bytes, int], str]:
    import public_tokenizers as public

    with open(path or public.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        return {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}, public.PATTERN


def perfect_hash(path: str | None = None) -> PerfectHash:
    """Built once on the driver, and sent to the workers."""
    if path not in _hashes:
        _hashes[path] = PerfectHash(list(_ranks(path)[0]))
    return _hashes[path]


_tokenizers: dict = {}


def tokenizer(path: str | None = None, hash_: PerfectHash | None = None) -> Tokenizer:
    """The tokenizer of a .tiktoken file, once for each worker."""
    if path not in _tokenizers:
        _tokenizers[path] = Tokenizer(*_ranks(path), hash_ or perfect_hash(path))
    return _tokenizers[path]


_memories: dict = {}


def memory(path: str | None, hash_: PerfectHash) -> BpeMemory:
    """The words that a worker has met."""
    if path not in _memories:
        _memories[path] = BpeMemory(tokenizer(path, hash_))
    return _memories[path]


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """One row for each row of docs: the id column and ids (array<int>), over whole texts of any length.

    Null and empty texts give an empty array. vocabulary is a path that every executor can open;
    by default the installed public file. Other columns of docs are not read, repeated rows give
    repeated results, and an empty table gives an empty one.
    """
    small_batches(docs.sparkSession, 64)
    shared = docs.sparkSession.sparkContext.broadcast(perfect_hash(vocabulary))

    def run(batches):
        own = memory(vocabulary, shared.value)
        for batch in together(batches, AT_ONCE):
            ids, bounds = token_ids(batch.column(1), own)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.astype(np.int32)))], names=["__id", "ids"])

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    return docs.select(f"`{id_col}`", f"`{text_col}`").mapInArrow(run, f"__id {kind}, ids array<int>").withColumnRenamed("__id", id_col)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """encode() and decode() in one pass, giving n_tokens and the SHA-256 of the ids and of the decoded bytes."""
    small_batches(docs.sparkSession, 64)
    shared = docs.sparkSession.sparkContext.broadcast(perfect_hash(vocabulary))

    def run(batches):
        own = memory(vocabulary, shared.value)
        for batch in together(batches, AT_ONCE):
            ids, bounds = token_ids(batch.column(1), own)
            ids_sha, text_sha, lo = [], [], 0
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + DIGESTED, "right")) - 1)
                some, own_bounds = ids[bounds[lo] : bounds[hi]].astype(np.int64), bounds[lo : hi + 1] - bounds[lo]
                for table, out, skip in ((own.own.shown, ids_sha, 1), (own.own.words, text_sha, 0)):
                    data, edge = table.joined(some)
                    at = edge[own_bounds].tolist()
                    out += [hashlib.sha256(data[min(a + skip, b) : b]).hexdigest() for a, b in zip(at, at[1:])]
                lo = hi
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(bounds), pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=["__id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    return docs.select(f"`{id_col}`", f"`{text_col}`").mapInArrow(run, f"__id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("__id", id_col)


def op5_bpe(spark, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
