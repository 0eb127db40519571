"""Removal of repeated passages by a multi-document suffix array, built column by column.

Texts are cut into overlapping pieces so that every window of `width` bytes lies in one piece: a
piece holds consecutive windows that share a minimiser (the smallest hash of the short strings in
a window). Equal windows have equal minimisers, so pieces are dealt by them, and only minimisers
that several documents have are dealt at all. Minimisers that very many documents have, found in a
sample, are dealt in parts: parts send their distinct pieces, each under its smallest document, to
one construction, and get the answers for their pieces back. The distinct pieces of a deal become the documents of
a collection, whose suffix array is built in rounds: a round inserts the next symbol from the right
of every piece into its pile of the Burrows-Wheeler transform, and updates the common prefixes of
neighbours. A round reads the columns of the round before once, in order and block by block, with
a count, a least prefix and the last occurrence carried for every symbol, and writes them anew: in
memory, or, where a collection is large, in sequential files of the shared folder. Runs of suffixes
with common prefixes of `width` or more are equal windows; those whose smallest document is another
one are removed.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .buffers import BASE, BYTE, INVERSE, mixed, powers, spans, starts_of, whole_groups
from .common import attach, drop_path, drop_written, settle, shared_dir, small_batches, written

#: Bytes of the strings that minimisers are chosen from, most windows in a piece, bytes of text a deal.
SHORT, WINDOWS, DEAL = 24, 64, 5_000_000
#: Entries of a column read or written at once, entries of a collection that pieces of several minimisers share, entries from which columns are files.
BLOCK, COLLECTION, IN_MEMORY = 1 << 18, 200_000, 8_000_000
#: Bytes of text that minimisers are taken from at once, values that a task holds before it sends them on.
SPAN, HELD = 64_000, 500_000
#: One of so many documents is looked at for minimisers of very many documents; pieces that make one of those; parts that they are dealt in.
SAMPLED, HOT, PARTS = 64, 200_000, 256


class Column:
    """Numbers that are written once and read in order: in memory or, beyond IN_MEMORY of them, in a file of a folder."""

    def __init__(self, n: int, folder: str | None):
        self.blocks, self.path = [], None
        if n > IN_MEMORY and folder:
            self.store, base = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder.removeprefix("file:"))
            self.store.create_dir(base, recursive=True)
            self.path, self.counts = f"{base}/{uuid.uuid4().hex}", []
            self.out = self.store.open_output_stream(self.path)

    def append(self, block: np.ndarray) -> None:
        if self.path is None:
            self.blocks.append(block)
        else:
            self.out.write(block.tobytes()), self.counts.append(len(block))

    def read(self) -> Iterator[np.ndarray]:
        if self.path is None:
            yield from self.blocks
            return
        self.out.close()
        with self.store.open_input_stream(self.path) as file:
            for n in self.counts:
                yield np.frombuffer(file.read(8 * n), np.uint64)

    def drop(self) -> None:
        self.blocks = []
        if self.path is not None:
            self.store.delete_file(self.path)


def collection(pieces: np.ndarray, lengths: np.ndarray, folder: str | None = None) -> Iterator[np.ndarray]:
    """The suffixes of all pieces in order, as blocks of entries, from all their bytes and their lengths under 256.

    Equal suffixes are ordered by piece; empty suffixes come first. An entry is one number: piece,
    length of the suffix, prefix shared with the suffix before, and in the lowest byte the symbol
    before the suffix, which is the transform. Symbols are the ranks of the bytes that occur, from
    1; 0 is before a whole piece.
    """
    if lengths.max(initial=0) > 255:
        raise ValueError("pieces must be shorter than 256 bytes")
    seen = np.bincount(pieces, minlength=256) > 0
    if seen.all():
        raise ValueError("pieces must leave out one byte value at least, as UTF-8 does")
    pieces = np.cumsum(seen).astype(np.uint8)[pieces]
    n, ends, symbols = len(lengths), np.cumsum(lengths), int(seen.sum()) + 1

    def entries(who: np.ndarray, j: int, prefix: np.ndarray) -> np.ndarray:
        before = np.zeros(len(who), np.uint64)
        more = lengths[who] > j
        before[more] = pieces[ends[who[more]] - j - 1]
        return who.astype(np.uint64) << np.uint64(24) | np.uint64(j << 16) | prefix.astype(np.uint64) << np.uint64(8) | before

    column = Column(n, folder)
    column.append(entries(np.arange(n), 0, np.zeros(n)))
    at = np.arange(n)  # places of the suffixes inserted last
    for j in range(1, int(lengths.max(initial=0)) + 1):
        symbol, rank, prefix, new, who, count = _extended(column, at, n, symbols)
        piles = np.cumsum(count) - count - count[0] + len(lengths)  # empty suffixes come first, ended pieces extend nothing
        place = piles[symbol] + rank
        earlier = np.cumsum(new) - new
        column = _rewritten(column, n, place[new] - earlier[new], entries(who[new], j, prefix[new]), place[~new] - earlier[~new], prefix[~new], folder)
        at = place[new]
        n += len(at)
    yield from column.read()
    column.drop()


def build(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(piece, length, prefix) of all suffixes of all pieces in order; prefix is shared with the suffix before."""
    entry = np.concatenate([*collection(np.frombuffer(b"".join(pieces), np.uint8), np.array([len(p) for p in pieces], np.int64))])
    return tuple((entry >> np.uint64(k)).astype(np.int64) & mask for k, mask in ((24, -1), (16, 255), (8, 255)))


def _extended(column: Column, at: np.ndarray, n: int, symbols: int) -> tuple[np.ndarray, ...]:
    """What a round changes, in the order of the piles: (symbol, rank in its pile, prefix, whether it is new, piece), and each pile's size.

    Changed are the suffixes that extend those at places `at`, and the prefixes of what follows
    them in their piles: one more than the least prefix since the last suffix with that symbol.
    """
    count = np.zeros(symbols, np.int64)  # of each symbol so far
    least = np.zeros(symbols, np.uint8)  # least prefix after a symbol's last occurrence
    fresh = np.zeros(symbols, bool)  # whether that occurrence is extended in this round
    found, start = [], 0
    for entry in column.read():
        k = len(entry)
        raw = entry.view(np.uint8)
        symbol, prefix = raw[0::8].copy(), np.full(k + 1, 255, np.uint8)
        prefix[:k] = raw[1::8]
        mine = at[np.searchsorted(at, start) : np.searchsorted(at, start + k)] - start
        own = np.zeros(k, bool)
        own[mine[symbol[mine] > 0]] = True
        order = np.argsort(symbol, kind="stable")  # by symbol, which is the order of the suffixes extended by it
        many = np.bincount(symbol, minlength=symbols)
        edge, there = np.cumsum(many) - many, np.flatnonzero(many)
        own = own[order]
        changed = own.copy()
        changed[1:] |= own[:-1]
        changed[edge[there]] = own[edge[there]] | fresh[there]
        nth = np.flatnonzero(changed)
        place = order[nth]
        s = symbol[place]
        first = nth == edge[s]
        low = _range_min(prefix, np.where(first, 0, order[nth - 1] + 1), place + 1)
        low = np.where(first, np.where(count[s] > 0, np.minimum(low, least[s]) + 1, 0), low + 1)
        found.append((s, count[s] + nth - edge[s], low, own[nth], (entry[place] >> np.uint64(24)).astype(np.int64)))
        count += many
        start += k
        if start < n:
            after = np.minimum.accumulate(prefix[:0:-1])[::-1]  # least prefix after each place
            least = np.minimum(least, prefix.min())
            least[there], fresh[there] = after[order[edge[there] + many[there] - 1]], own[edge[there] + many[there] - 1]
    s, *rest = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(s, kind="stable")
    return s[order], *(x[order] for x in rest), count


def _rewritten(column: Column, n: int, into: np.ndarray, entries: np.ndarray, again: np.ndarray, prefix: np.ndarray, folder: str | None) -> Column:
    """The next column: entries inserted before the places `into` of this one, and new prefixes at the places `again`."""
    out, start = Column(n + len(into), folder), 0
    prefix = prefix.astype(np.uint64) << np.uint64(8)
    for block in column.read():
        k = len(block)
        x, y = np.searchsorted(again, (start, start + k))
        if y > x:
            block, at = block.copy(), again[x:y] - start
            block[at] = block[at] & ~np.uint64(0xFF00) | prefix[x:y]
        x, y = np.searchsorted(into, start), np.searchsorted(into, start + k) if start + k < n else len(into)
        whole, old = np.empty(k + y - x, np.uint64), np.ones(k + y - x, bool)
        at = into[x:y] - start + np.arange(y - x)
        old[at] = False
        whole[old], whole[at] = block, entries[x:y]
        for half in np.array_split(whole, 2) if len(whole) > 2 * BLOCK else [whole]:
            out.append(half)
        start += k
    column.drop()
    return out


def _range_min(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Least of values[lo:hi] for each range; ranges are not empty."""
    if not len(lo):
        return np.empty(0, values.dtype)
    order = np.argsort(lo)  # else what lies between two ranges is gone through too
    padded = np.append(values, values.dtype.type(0))
    out = np.empty(len(lo), values.dtype)
    out[order] = np.minimum.reduceat(padded, np.column_stack((lo[order], hi[order])).ravel())[::2]
    return out


def pieces_of(data: np.ndarray, offsets: np.ndarray, width: int):
    """(row, minimiser, start, windows) of the pieces of texts; start is in data."""
    none = np.empty(0, np.int64)
    if len(data) < width:
        return none, none.astype(np.uint64), none, none
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE[data] * powers(len(data), BASE), out=sums[1:])
    short = min(SHORT, width)
    h = mixed((sums[short:] - sums[:-short]) * powers(len(data) - short + 1, INVERSE))
    del sums
    span, low = 1, h
    while 2 * span <= width - short + 1:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    rest = width - short + 1 - span
    low = np.minimum(low[: len(low) - rest], low[rest:])
    n = len(data) - width + 1
    last = np.maximum(offsets[1:] - width, offsets[:-1] - 1)  # last window of a text
    live = np.zeros(n + 1, np.int8)
    np.add.at(live, np.minimum(offsets[:-1], n), 1)
    np.add.at(live, np.minimum(last + 1, n), -1)
    live = np.cumsum(live[:-1]) > 0
    new = np.ones(n, bool)
    new[1:] = low[1:] != low[:-1]
    inner = offsets[offsets < n]
    new[inner] = True
    new[1:] |= live[1:] != live[:-1]
    start = np.flatnonzero(new)
    count = np.diff(np.append(start, n))
    keep = live[start]
    start, count = start[keep], count[keep]
    if (count > WINDOWS).any():  # a run of one symbol, say, is cut
        parts = -(-count // WINDOWS)
        k = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        start, count = np.repeat(start, parts) + k * WINDOWS, np.repeat(count, parts) - k * WINDOWS
        count = np.minimum(count, WINDOWS)
    return np.searchsorted(offsets, start, "right") - 1, low[start], start, count


def _packed(a: np.ndarray) -> bytes:
    return zstandard.compress(a.tobytes(), 1)


def _unpacked(b: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(b), kind)


def _runs(sorted_: np.ndarray) -> np.ndarray:
    """Where runs of equal values start, and the length of all."""
    if not len(sorted_):
        return np.zeros(1, np.int64)
    return np.append(np.flatnonzero(np.concatenate(([True], sorted_[1:] != sorted_[:-1]))), len(sorted_))


def _by(bucket: np.ndarray):
    """Rows by bucket: an order, and (bucket, from, to) of those that occur."""
    order = np.argsort(bucket, kind="stable")
    edges = _runs(bucket[order])
    return order, [(int(bucket[order[a]]), a, b) for a, b in zip(edges.tolist(), edges[1:].tolist())]


def _batch(names: str, kinds: list, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows) if rows else [[]] * len(kinds), kinds)], names=names.split())


def _sent(found: Iterable[tuple[np.ndarray, ...]], buckets: int) -> Iterator[pa.RecordBatch]:
    """(bucket, values) of columns of numbers, the first of which is a document: a row for each bucket of documents, HELD or more values at a time."""
    held, size = [], 0

    def flush():
        columns = [np.concatenate(c) for c in zip(*held)]
        order, parts = _by((mixed(columns[0].view(np.uint64).copy()) % np.uint64(buckets)).astype(np.int64))
        columns = [c[order] for c in columns]
        return _batch("bucket values", [pa.int64(), pa.binary()], [(b, _packed(np.stack([c[x:y].view(np.int64) for c in columns]))) for b, x, y in parts])

    for columns in found:
        held.append(columns)
        size += len(columns[0])
        if size >= HELD:
            yield flush()
            held, size = [], 0
    if size:
        yield flush()


def _buckets(batches, columns: int) -> Iterator[np.ndarray]:
    """The columns of numbers of each bucket."""
    for table in whole_groups(batches, ["bucket"]):
        edges = _runs(table.column("bucket").to_numpy())
        for a, b in zip(edges, edges[1:]):
            yield np.concatenate([_unpacked(x, np.int64).reshape(columns, -1) for x in table.column("values").slice(a, b - a).to_pylist()], 1)


def _hot(docs: DataFrame, width: int, total: int) -> np.ndarray:
    """Minimisers of some HOT pieces or more, by a sample of documents, sorted; whatever the sample says changes no result.

    The least number grows with the bytes of all texts, so there are some 10,000 at most.
    """

    def run(batches):
        for batch in batches:
            keys = np.concatenate([pieces_of(data, offsets, width)[1] for _, _, data, offsets in spans(batch.column("text"), SPAN)])
            key, n = np.unique(keys, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n, pa.int64())], names=["key", "n"])

    some = docs.where(F.pmod(F.xxhash64("id", F.lit(31)), F.lit(SAMPLED)) == 0).select("text").mapInArrow(_nonempty(run), "key long, n long")
    least = max(HOT, total // 100_000)
    found = some.groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") * SAMPLED >= least).select("key").toArrow()
    return np.sort(found["key"].to_numpy().astype(np.int64).view(np.uint64))


def _within(key: np.ndarray, sorted_: np.ndarray) -> np.ndarray:
    """Whether each key is among sorted ones."""
    if not len(sorted_):
        return np.zeros(len(key), bool)
    return sorted_[np.minimum(np.searchsorted(sorted_, key), len(sorted_) - 1)] == key


def _seen(docs: DataFrame, width: int, deals: int, hot: np.ndarray) -> DataFrame:
    """(deal, keys, ids): minimisers of pieces that are not hot and their documents, packed."""

    def run(batches):
        for batch in batches:
            ids, keys, docs = batch.column("id").to_numpy(), [], []
            for lo, _, data, offsets in spans(batch.column("text"), SPAN):
                row, key, _, _ = pieces_of(data, offsets, width)
                keys.append(key), docs.append(ids[lo + row])
            key, doc = np.concatenate(keys), np.concatenate(docs)
            cold = ~_within(key, hot)
            key, doc = key[cold], doc[cold]
            order, parts = _by((key % np.uint64(deals)).astype(np.int64))
            key, doc = key[order], doc[order]
            yield _batch("deal keys ids", [pa.int64(), pa.binary(), pa.binary()], [(b, key[x:y].tobytes(), _packed(doc[x:y])) for b, x, y in parts])

    return docs.select("id", "text").mapInArrow(_nonempty(run), "deal long, keys binary, ids binary")


def _nonempty(run):
    return lambda batches: run(b for b in batches if b.num_rows)


def _repeated(seen: DataFrame, buckets: int) -> DataFrame:
    """(doc, keys): the minimisers of a document that another document has too."""

    def found(batches):
        for table in _deals(batches, ["keys", "ids"]):
            key, doc = np.concatenate([np.frombuffer(x, np.uint64) for x in table["keys"]]), np.concatenate([_unpacked(x, np.int64) for x in table["ids"]])
            order = np.argsort(key)
            key, doc = key[order], doc[order]
            edges = _runs(key)
            many = np.minimum.reduceat(doc, edges[:-1]) != np.maximum.reduceat(doc, edges[:-1])
            keep = np.repeat(many, np.diff(edges))
            yield doc[keep], key[keep]

    def run(batches):
        for doc, key in _buckets(batches, 2):
            order = np.argsort(doc, kind="stable")
            doc, key = doc[order], key[order]
            edges = _runs(doc)
            yield pa.RecordBatch.from_arrays([pa.array(doc[edges[:-1]], pa.int64()), pa.array([key[a:b].tobytes() for a, b in zip(edges, edges[1:])], pa.binary())], names=["doc", "keys"])

    packed = seen.repartition("deal").sortWithinPartitions("deal").mapInArrow(lambda batches: _sent(found(batches), buckets), "bucket long, values binary")
    return packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "doc long, keys binary")


def _deals(batches, columns: list[str]):
    """The packed columns of each deal."""
    for table in whole_groups(batches, ["deal"]):
        edges = _runs(table.column("deal").to_numpy())
        for a, b in zip(edges, edges[1:]):
            yield {c: table.column(c).slice(a, b - a).to_pylist() for c in columns}


PACKED = "deal long, part int, ids binary, digests binary, keys binary, which binary, starts binary, counts binary, bytes binary"


def _pieces(docs: DataFrame, width: int, deals: int, hot: np.ndarray | None = None) -> DataFrame:
    """The pieces of docs (id, digest, text, keys) whose minimisers are among the row's keys, packed, in part 0.

    With `hot`, those whose minimisers are among these: a deal for each, in PARTS parts by documents.
    """

    def run(batches):
        for batch in batches:
            ids, digests = batch.column("id").to_numpy(), batch.column("digest").to_numpy()
            wanted, found = batch.column("keys").to_pylist() if hot is None else [], []
            part = 0 if hot is None else int(mixed(ids[:1].astype(np.int64).view(np.uint64).copy())[0] % np.uint64(PARTS))
            for lo, hi, data, offsets in spans(batch.column("text"), SPAN):
                row, key, start, count = pieces_of(data, offsets, width)
                edges = np.searchsorted(row, np.arange(hi - lo + 1))
                keep = np.concatenate([np.isin(key[a:b], np.frombuffer(w, np.uint64)) for a, b, w in zip(edges, edges[1:], wanted[lo:hi])]) if hot is None else _within(key, hot)
                row, key, start, count = row[keep], key[keep], start[keep], count[keep]
                length = count + width - 1
                inside = np.arange(length.sum()) + np.repeat(start - np.cumsum(length) + length, length)
                found.append((lo + row, key, start - offsets[row], count, data[inside]))
            row, key, start, count, data = (np.concatenate(x) for x in zip(*found))
            length = count + width - 1
            begin = np.cumsum(length) - length
            order, parts = _by((key % np.uint64(deals) if hot is None else np.searchsorted(hot, key)).astype(np.int64))
            rows = []
            for b, x, y in parts:
                at = order[x:y]
                there, which = np.unique(row[at], return_inverse=True)
                inside = np.arange(length[at].sum()) + np.repeat(begin[at] - np.cumsum(length[at]) + length[at], length[at])
                rows.append((b, part, *map(_packed, (ids[there], digests[there], (key[at] >> np.uint64(32)).astype(np.uint32), which.astype(np.int32), start[at], count[at].astype(np.int32), data[inside]))))
            yield _batch(" ".join(f.split()[0] for f in PACKED.split(", ")), [pa.int64(), pa.int32(), *[pa.binary()] * 7], rows)

    return docs.select("id", "digest", "text", *(["keys"] if hot is None else [])).mapInArrow(_nonempty(run), PACKED)


def _firsts(pieces: list[bytes], least: np.ndarray, group: np.ndarray, width: int, folder: str) -> tuple[np.ndarray, np.ndarray]:
    """The smallest document of every window of distinct pieces, one after another, and where a piece's windows start.

    A piece has its smallest document and a group; equal windows are in one group. Groups of one
    piece need no suffix array.
    """
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
    windows = lengths - width + 1
    base = np.cumsum(windows) - windows
    out = np.repeat(least, windows)
    order = np.argsort(group, kind="stable")
    edges = _runs(group[order])
    several = np.flatnonzero(np.diff(edges) > 1)
    start = 0
    bytes_of = np.add.reduceat(lengths[order], edges[:-1])[several] if len(order) else several
    while start < len(several):
        end = max(start + 1, int(np.searchsorted(np.cumsum(bytes_of[start:]), COLLECTION, "right")) + start)
        mine = np.concatenate([order[edges[g] : edges[g + 1]] for g in several[start:end]])
        found = [block[(block >> np.uint64(16)).astype(np.uint8) >= width] for block in collection(np.frombuffer(b"".join([pieces[i] for i in mine.tolist()]), np.uint8), lengths[mine], folder)]
        entry = np.concatenate(found)
        who, size, prefix = mine[(entry >> np.uint64(24)).astype(np.int64)], (entry >> np.uint64(16)).astype(np.int64) & 255, (entry >> np.uint64(8)).astype(np.uint8)
        begin = np.flatnonzero(np.concatenate(([True], prefix[1:] < width)))
        out[base[who] + lengths[who] - size] = np.repeat(np.minimum.reduceat(least[who], begin), np.diff(np.append(begin, len(who))))
        start = end
    return out, base


class Occurrences:
    """The pieces of one deal, or of a part of one, from its packed rows."""

    def __init__(self, t: dict, width: int):
        read = lambda c, kind: [_unpacked(x, kind) for x in t[c]]
        which = read("which", np.int32)
        self.doc, self.of = (np.concatenate([d[w] for d, w in zip(read(c, np.int64), which)]) for c in ("ids", "digests"))
        self.start, self.count = np.concatenate(read("starts", np.int64)), np.concatenate(read("counts", np.int32)).astype(np.int64)
        self.key = np.concatenate(read("keys", np.uint32))
        self.raw = b"".join(zstandard.decompress(x) for x in t["bytes"])
        self.edge = np.concatenate(([0], np.cumsum(self.count + width - 1)))
        self.width = width

    def distinct(self) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """The distinct pieces, the number of each piece among them, and the smallest document of each."""
        names: dict[bytes, int] = {}
        nth = np.array([names.setdefault(self.raw[a:b], len(names)) for a, b in zip(self.edge.tolist(), self.edge[1:].tolist())], np.int64)
        least = np.full(len(names), np.iinfo(np.int64).max)
        np.minimum.at(least, nth, self.doc)
        return list(names), nth, least

    def cuts(self, first: np.ndarray, base: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """(doc, of, start, end) of what goes: `first` has the smallest documents of windows, from base on for each piece."""
        inside = np.arange(self.count.sum()) - np.repeat(np.cumsum(self.count) - self.count, self.count)
        hit = first[np.repeat(base, self.count) + inside] < np.repeat(self.doc, self.count)
        which = np.repeat(np.arange(len(self.count)), self.count)[hit]
        s = self.start[which] + inside[hit]
        if not len(s):
            return
        fresh = np.concatenate(([True], (which[1:] != which[:-1]) | (s[1:] > s[:-1] + self.width)))
        ends = s[np.append(np.flatnonzero(fresh)[1:], len(s)) - 1] + self.width
        which = which[fresh]
        yield self.doc[which], self.of[which], s[fresh], ends


COLUMNS = ["ids", "digests", "keys", "which", "starts", "counts", "bytes"]


def _found(packed: DataFrame, width: int, buckets: int, folder: str) -> DataFrame:
    """(bucket, values): cuts of the deals, packed by documents."""

    def found(batches):
        for t in _deals(batches, COLUMNS):
            own = Occurrences(t, width)
            pieces, nth, least = own.distinct()
            group = np.empty(len(pieces), np.uint32)
            group[nth] = own.key
            first, base = _firsts(pieces, least, group, width, folder)
            yield from own.cuts(first, base[nth])

    return packed.repartition("deal").sortWithinPartitions("deal").mapInArrow(lambda batches: _sent(found(batches), buckets), "bucket long, values binary")


def _found_in_parts(packed: DataFrame, width: int, buckets: int, folder: str) -> DataFrame:
    """_found() for deals of any size: no task has more than a part's occurrences, or a deal's distinct pieces."""
    keys = ["deal", "part"]

    def parts(batches):
        for table in whole_groups(batches, keys):
            at = starts_of(table, keys)
            for a, b in zip(at, at[1:]):
                yield table.slice(a, 1), {c: table.column(c).slice(a, b - a).to_pylist() for c in table.column_names}

    def gathered(batches):
        for row, t in parts(batches):
            pieces, _, least = Occurrences(t, width).distinct()
            yield pa.RecordBatch.from_arrays([row.column(k).combine_chunks() for k in keys] + [pa.array([pieces], pa.list_(pa.binary())), pa.array([least], pa.list_(pa.int64()))], names=[*keys, "pieces", "least"])

    def answered(batches):
        for table in whole_groups(batches, ["deal"]):
            at = starts_of(table, ["deal"])
            for a, b in zip(at, at[1:]):
                deal, lists, leasts = (table.column(c).slice(a, b - a).to_pylist() for c in ("part", "pieces", "least"))
                every = {}
                for pieces, least in zip(lists, leasts):
                    for piece, doc in zip(pieces, least):
                        every[piece] = min(doc, every.get(piece, doc))
                all_ = list(every)
                first, base = _firsts(all_, np.array([every[x] for x in all_]), np.zeros(len(all_), np.uint32), width, folder)
                at_of = {x: (i, i + len(x) - width + 1) for x, i in zip(all_, base.tolist())}
                for part, pieces in zip(deal, lists):
                    values = [first[slice(*at_of[x])].tobytes() for x in pieces]
                    yield pa.RecordBatch.from_arrays([table.column("deal").slice(a, 1).combine_chunks(), pa.array([part], pa.int32()), pa.array([pieces], pa.list_(pa.binary())), pa.array([values], pa.list_(pa.binary()))], names=[*keys, "pieces", "firsts"])

    forms = written(packed.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(gathered, "deal long, part int, pieces array<binary>, least array<long>"), "forms")
    answers = forms.repartition("deal").sortWithinPartitions("deal").mapInArrow(answered, "deal long, part int, pieces array<binary>, firsts array<binary>")
    none = F.lit(None).cast("binary")
    both = packed.select("*", F.lit(None).cast("array<binary>").alias("pieces"), F.lit(None).cast("array<binary>").alias("firsts"))
    both = both.unionByName(answers.select(*keys, *[none.alias(c) for c in COLUMNS], "pieces", "firsts"))

    def found(batches):
        for _, t in parts(batches):
            rows = [i for i, p in enumerate(t["pieces"]) if p is None]
            answer = next(i for i, p in enumerate(t["pieces"]) if p is not None)
            own = Occurrences({c: [t[c][i] for i in rows] for c in COLUMNS}, width)
            pieces, nth, _ = own.distinct()
            known = dict(zip(t["pieces"][answer], t["firsts"][answer]))
            lists = [np.frombuffer(known[x], np.int64) for x in pieces]
            base = np.cumsum([0, *map(len, lists)])[:-1]
            yield from own.cuts(np.concatenate(lists), base[nth])

    return both.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(lambda batches: _sent(found(batches), buckets), "bucket long, values binary")


def _cuts(found: DataFrame) -> DataFrame:
    """(doc, of, cuts): byte ranges to remove from a document, packed pairs of start and end."""

    def run(batches):
        for columns in _buckets(batches, 4):
            doc, of, start, end = columns[:, np.lexsort(columns[2::-1])]
            edges = np.append(np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (of[1:] != of[:-1])))), len(doc))
            cuts = [_merged(start[a:b], end[a:b]).tobytes() for a, b in zip(edges, edges[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(doc[edges[:-1]]), pa.array(of[edges[:-1]]), pa.array(cuts, pa.binary())], names=["doc", "of", "cuts"])

    return found.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "doc long, of long, cuts binary")


def _rest(data: bytes, cuts: bytes) -> tuple[bytes, np.ndarray]:
    """What is left of a text, and the ranges that go."""
    pairs = np.frombuffer(cuts, np.int64).reshape(-1, 2)
    return b"".join(data[a:b] for a, b in zip([0, *pairs[:, 1].tolist()], [*pairs[:, 0].tolist(), len(data)])), pairs


def _merged(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Byte ranges, sorted by start, without overlaps or touching ends."""
    reach = np.maximum.accumulate(end)
    new = np.flatnonzero(np.concatenate(([True], start[1:] > reach[:-1])))
    return np.column_stack((start[new], reach[np.append(new[1:], len(start)) - 1]))


def _fates(docs: DataFrame, width: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Of docs (id, text): the rows as they are known, (id, n, sha, digest, copy); the key of copies, which lose all; the cuts of the others by key, and these others."""
    spark = docs.sparkSession
    small_batches(spark)
    raw = F.col("text").cast("binary")
    digests = written(docs.select("id", F.octet_length("text").cast("long").alias("n"), F.sha2(raw, 256).alias("sha"), F.xxhash64("text").alias("digest")), "digests")
    # whole texts that are equal are one: all but the smallest id lose every byte
    firsts = digests.where("id IS NOT NULL").groupBy(F.col("sha").alias("s")).agg(F.min("id").alias("least")).hint("rebalance")
    known = written(digests.join(firsts, F.col("sha") == F.col("s"), "left").withColumn("copy", F.coalesce(F.col("id") > F.col("least"), F.lit(False)) & (F.col("n") >= width)).select("id", "n", "sha", "digest", "copy"), "known")
    drop_written(digests)
    copies = known.where("copy").select(F.struct("id", "digest").alias("ck")).distinct()
    total = known.agg(F.sum("n")).first()[0] or 0
    deals = max(1, -(-total // DEAL))
    alone = docs.where(F.col("id").isNotNull() & (F.octet_length("text") >= width)).withColumn("digest", F.xxhash64("text"))
    alone = attach(alone.withColumn("k", F.struct("id", "digest")), copies, "k", "ck").where("ck IS NULL").select("id", "digest", "text")
    hot = _hot(alone, width, total)
    again = written(_repeated(_seen(alone, width, deals, hot), deals), "keys")
    folder = f"{shared_dir(spark)}/lodestar-columns-{uuid.uuid4().hex}"
    found = _found(_pieces(attach(alone, again, "id", "doc").where("doc IS NOT NULL"), width, deals), width, deals, folder)
    if len(hot):
        found = found.union(_found_in_parts(written(_pieces(alone, width, deals, hot), "hot"), width, deals, folder))
    settle(spark)
    cuts = written(_cuts(found), "cuts")
    drop_written(again)
    settle(spark)
    drop_path(spark, folder)
    cuts = cuts.select(F.struct(F.col("doc").alias("id"), F.col("of").alias("digest")).alias("ck"), "cuts")
    return known, copies, cuts, alone


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 50) -> DataFrame:
    """One row for each row of docs: id, n_bytes, n_removed, n_spans, kept_sha256, and spans (start, end of bytes).

    A byte goes if a string of `width` bytes that covers it also starts in a document of a smaller
    id; strings are judged on the input and never cross documents. Null counts as empty; empty and
    short texts keep all. Rows of null id lose nothing and take nothing from others. Rows of equal
    id take nothing from each other. Other columns are not read; an empty
    table gives an empty result.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    known, copies, cuts, alone = _fates(docs, width)

    def run(batches):
        for batch in batches:
            removed, n_spans, shas, ranges = [], [], [], []
            for text, cut in zip(batch.column("text"), batch.column("cuts")):
                data = text.as_buffer().to_pybytes()
                rest, pairs = _rest(data, cut.as_py())
                removed.append(len(data) - len(rest)), n_spans.append(len(pairs)), shas.append(hashlib.sha256(rest).hexdigest())
                ranges.append([{"start": a, "end": b} for a, b in pairs.tolist()])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("digest"), pa.array(removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(shas, pa.string()), pa.array(ranges, kind)], names=["i", "d", "n_removed", "n_spans", "kept_sha256", "spans"])

    hit = attach(alone.withColumn("k", F.struct("id", "digest")), cuts, "k", "ck").where("ck IS NOT NULL").select("id", "digest", "text", "cuts")
    cut = hit.mapInArrow(run, "i long, d long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>").dropDuplicates(["i", "d"])
    out = known.join(cut, (F.col("id") == F.col("i")) & (F.col("digest") == F.col("d")) & ~F.col("copy"), "left")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n").alias("end")))
    pick = lambda copy, cut, else_: F.when(F.col("copy"), copy).otherwise(F.coalesce(F.col(cut), else_))
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    return out.select(
        F.col("id").alias(id_col), F.col("n").alias("n_bytes"), pick(F.col("n"), "n_removed", F.lit(0).cast("long")).alias("n_removed"),
        pick(F.lit(1).cast("long"), "n_spans", F.lit(0).cast("long")).alias("n_spans"), pick(F.lit(hashlib.sha256(b"").hexdigest()), "kept_sha256", F.col("sha")).alias("kept_sha256"),
        pick(whole, "spans", none).alias("spans"),
    )


def without_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 50) -> DataFrame:
    """docs with repeated passages cut out of the text; rows that lose nothing pass without a shuffle of their text."""
    read = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    _, copies, cuts, _ = _fates(read, width)
    lost = cuts.unionByName(copies.withColumn("cuts", F.lit(b""))).select(F.col("ck").alias("__key"), F.col("cuts").alias("__cuts"))

    @F.pandas_udf("string")
    def rest(text: pd.Series, cuts: pd.Series) -> pd.Series:
        return pd.Series([None if c is None else _rest(t.encode(), c)[0].decode("utf-8", "ignore") if len(c) else "" for t, c in zip(text, cuts)], dtype=object)

    keyed = docs.withColumn("__own", F.struct(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("digest")))
    out = attach(keyed, lost, "__own", "__key")
    goes = F.col("__key").isNotNull()
    # only texts that lose something are sent to Python
    out = out.withColumn("__rest", rest(F.when(goes, F.col(text_col)), F.col("__cuts")))
    return out.select(*[F.when(goes, F.col("__rest")).otherwise(F.col(c)).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])


def op3_suffix(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return repeated_passages(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


#: Every window of every text, its smallest document, and the runs of removed bytes.
SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, substr(h, CAST(2 * i + 1 AS BIGINT), 100) AS s FROM (SELECT doc_id, h, unnest(range(0, greatest(length(h) // 2 - 49, 0))) AS i FROM d)),
f AS (SELECT s, min(doc_id) AS first FROM w GROUP BY 1),
hit AS (SELECT doc_id, i FROM w JOIN f USING (s) WHERE first < doc_id),
g AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS new FROM hit),
k AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g),
r AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM k GROUP BY doc_id, run),
q AS (SELECT r.doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY r.doc_id ORDER BY a), 0) AS before, h FROM r JOIN d USING (doc_id)),
c AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, string_agg(substr(h, CAST(2 * before + 1 AS BIGINT), CAST(2 * (a - before) AS BIGINT)), '' ORDER BY a) || substr(any_value(h), CAST(2 * max(b) + 1 AS BIGINT)) AS rest FROM q GROUP BY 1)
SELECT doc_id, length(h) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(rest, h))) AS kept_sha256 FROM d LEFT JOIN c USING (doc_id)
"""
