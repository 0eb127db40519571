"""Text columns as byte arrays for vectorised operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once, unless one text alone has more.
AT_ONCE = 500_000


def spans(column: pa.Array, limit: int = AT_ONCE):
    """(first, last + 1, bytes, offsets) for runs of rows of a string column; null counts as empty."""
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.empty(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def lowered() -> np.ndarray:
    """A table of bytes that folds A-Z."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def mixed(h: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3, in place."""
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


#: Base of polynomial hashes modulo 2**64, its inverse, and a random value for each byte.
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
BYTE = np.random.default_rng(20_240_229).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


_powers: dict[int, np.ndarray] = {}


def powers(n: int, base: int) -> np.ndarray:
    """base ** 0 to base ** (n - 1) modulo 2**64; those for usual lengths are kept."""
    if n <= AT_ONCE:
        if base not in _powers:
            _powers[base] = _all_powers(AT_ONCE, base)
        return _powers[base][:n]
    return _all_powers(n, base)


def _all_powers(n: int, base: int) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    np.multiply.accumulate(out, out=out)
    return out[:n]


def words(data: np.ndarray, offsets: np.ndarray):
    """(row, hash) of every word `[^\\x20\\x09-\\x0D]+` of folded texts, in order."""
    d = lowered()[data]
    space = (d == 32) | ((d >= 9) & (d <= 13))
    edge = np.zeros(len(d) + 1, bool)
    edge[offsets] = True
    inside = ~space
    first = inside & (edge[:-1] | np.concatenate(([True], space[:-1])))
    last = inside & (edge[1:] | np.concatenate((space[1:], [True])))
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    sums = np.zeros(len(d) + 1, np.uint64)
    np.cumsum(BYTE[d] * powers(len(d), BASE), out=sums[1:])
    h = mixed((sums[e] - sums[s]) * powers(len(d), INVERSE)[s] + (e - s).astype(np.uint64)) if len(s) else np.empty(0, np.uint64)
    return np.searchsorted(offsets, s, "right") - 1, h


def shingles(data: np.ndarray, offsets: np.ndarray, width: int):
    """For every row, the sorted distinct hashes of its runs of `width` words; of all words where there are fewer."""
    row, h = words(data, offsets)
    bounds = np.searchsorted(row, np.arange(len(offsets)))
    odd = np.uint64(0xD6E8FEB86659FD93)
    run = np.zeros(max(0, len(h) - width + 1), np.uint64)
    for k in range(width):
        run = run * odd + h[k : k + len(run)]
    run = mixed(run)
    for a, b in zip(bounds, bounds[1:]):
        if b - a >= width:
            part = np.sort(run[a : b - width + 1])
            yield part[np.concatenate(([True], part[1:] != part[:-1]))]
        elif b > a:
            whole = np.array([b - a], np.uint64)
            for x in h[a:b]:
                whole = whole * odd + x
            yield mixed(whole)
        else:
            yield run[:0]


def whole_groups(batches, keys: list[str]):
    """Arrow tables that end where a group ends, from batches sorted by keys."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        if held:
            before, now = (b.select(keys).slice(at, 1).to_pylist()[0] for b, at in ((held[-1], held[-1].num_rows - 1), (batch, 0)))
            if before != now:
                yield pa.Table.from_batches(held)
                held = []
        cut = _last_change(batch, keys)
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = [batch.slice(cut)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def starts_of(table, keys: list[str]) -> np.ndarray:
    """Where groups of equal keys start, and the number of rows."""
    new = np.zeros(table.num_rows, bool)
    new[0] = True
    for k in keys:
        v = table.column(k).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.append(np.flatnonzero(new), table.num_rows)


def _last_change(batch, keys: list[str]) -> int:
    return int(starts_of(pa.Table.from_batches([batch]), keys)[-2])
