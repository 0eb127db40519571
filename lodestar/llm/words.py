"""Ids of texts by looking up whole words: a word after a space has the same ids wherever it stands, so words are encoded once."""

from __future__ import annotations

import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words whose ids are remembered, beyond which a memory starts anew; bytes of text that are looked up at once.
REMEMBERED, AT_ONCE = 1_000_000, 4_000_000
#: A space between white space, or between white space and the end.
_BLANKS = re.compile(r"\s \s|\s \Z")
#: Letters of one pre-token in every version of Unicode, and punctuation after them that no contraction opens.
_MARKED = "^(?P<letters>[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)(?P<marks>[!-&(-/:-@\\[-`{-~]*)$"


def flat(found: list) -> tuple[np.ndarray, np.ndarray]:
    """All ids of lists of ids, and the lists' lengths."""
    return np.frombuffer(b"".join([array("I", ids).tobytes() for ids in found]), np.uint32), np.array([len(ids) for ids in found], np.int64)


def filled(out: np.ndarray, to: np.ndarray, ids: np.ndarray, begin: np.ndarray, length: np.ndarray) -> None:
    """Copies runs ids[begin:begin + length] to out, each from its place in `to` on."""
    before = np.cumsum(length) - length
    nth = np.arange(int(length.sum()))
    out[nth + np.repeat(to - before, length)] = ids[nth + np.repeat(begin - before, length)]


class Runs:
    """Ids of distinct strings, one run after another; found again by a hash join, without an object for each."""

    def __init__(self):
        self.keys, self.n = pa.array([], pa.large_string()), 0
        self.ids, self.start = np.empty(1 << 16, np.uint32), np.zeros((1 << 16) + 1, np.int64)

    def find(self, keys: pa.Array) -> np.ndarray:
        """The place of each key, or -1."""
        return pc.index_in(keys, value_set=self.keys).fill_null(-1).to_numpy().astype(np.int64)

    def add(self, keys: pa.Array, ids: np.ndarray, length: np.ndarray) -> None:
        end = self.start[self.n] + len(ids)
        while end > len(self.ids):
            self.ids = np.concatenate((self.ids, np.empty_like(self.ids)))
        while self.n + len(length) >= len(self.start):
            self.start = np.concatenate((self.start, np.zeros_like(self.start)))
        self.ids[self.start[self.n] : end] = ids
        self.start[self.n + 1 : self.n + 1 + len(length)] = self.start[self.n] + np.cumsum(length)
        self.keys, self.n = pa.concat_arrays([self.keys, keys]), self.n + len(length)

    def run(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and length of the runs at some places."""
        return self.start[place], self.start[place + 1] - self.start[place]


class Memory:
    """Ids of words after a space that have been met; at most REMEMBERED words, then it starts anew.

    A word of letters and punctuation after them is two pre-tokens, so its letters are looked up,
    and encoded, on their own. Subclasses say how texts are encoded.
    """

    def __init__(self):
        self.clear()

    def whole(self, texts: list[str]) -> list:
        """Ids of texts as they are."""
        raise NotImplementedError

    def letters(self, keys: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of letters after a space, and their numbers."""
        return flat(self.whole([" " + w for w in keys.to_pylist()]))

    def others(self, words: list[str]) -> list:
        """Ids of any words after a space."""
        return self.whole([" " + w for w in words])

    def clear(self) -> None:
        self.words, self.stems, self.marks = Runs(), Runs(), Runs()

    def _known(self, runs: Runs, keys: pa.Array, encode) -> np.ndarray:
        """Places of distinct keys; those not met before are encoded."""
        place = runs.find(keys)
        new = np.flatnonzero(place < 0)
        if len(new):
            place[new] = runs.n + np.arange(len(new))
            missing = keys.take(pa.array(new))
            runs.add(missing, *encode(missing))
        return place

    def places(self, words: pa.Array) -> np.ndarray:
        """Places in self.words of some distinct words."""
        if self.words.n + len(words) > REMEMBERED:
            self.clear()
        return self._known(self.words, words, self._words)

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their number for new words."""
        parts = pc.extract_regex(words, _MARKED)
        split, rest = (np.flatnonzero(f(parts).to_numpy(zero_copy_only=False)) for f in (pc.is_valid, pc.is_null))
        length, plan = np.zeros(len(words), np.int64), []
        for runs, name, encode in ((self.stems, "letters", self.letters), (self.marks, "marks", lambda keys: flat(self.whole(keys.to_pylist())))):
            keys = parts.field(name).take(pa.array(split)).cast(pa.large_string()).dictionary_encode()
            begin, own = runs.run(self._known(runs, keys.dictionary, encode)[keys.indices.to_numpy()])
            plan.append((split, length[split], runs, begin, own))
            length[split] += own
        ids, length[rest] = flat(self.others(words.take(pa.array(rest)).to_pylist()))
        at = np.cumsum(length) - length
        out = np.empty(int(length.sum()), np.uint32)
        for rows, shift, runs, begin, own in plan:
            filled(out, at[rows] + shift, runs.ids, begin, own)
        filled(out, at[rest], ids, np.cumsum(length[rest]) - length[rest], length[rest])
        return out, length


def token_ids(texts: pa.Array, memory: Memory) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, one after another, and where each text's start and the last ends.

    A word after a space has the same ids wherever it stands, unless white space surrounds that
    space; texts that have such a place, and the first word of each text, are encoded as they are.
    """
    texts = texts.fill_null("").cast(pa.large_string())
    plain = texts.to_pylist()
    whole = [_BLANKS.search(t) is not None for t in plain]
    split = pc.split_pattern(pc.if_else(pa.array(whole), pa.scalar("", pa.large_string()), texts), " ")
    offsets = split.offsets.to_numpy().astype(np.int64)
    words = split.values.slice(offsets[0], offsets[-1] - offsets[0])
    offsets = offsets - offsets[0]
    heads = words.take(pa.array(offsets[:-1])).to_pylist()
    heads, sizes = flat(memory.whole([t if w else h for t, w, h in zip(plain, whole, heads)]))
    first = np.zeros(len(words), bool)
    first[offsets[:-1]] = True
    words = words.dictionary_encode()
    later = np.flatnonzero(~first)
    code = words.indices.to_numpy()[later]
    used = np.zeros(len(words.dictionary), bool)  # not all: some are first words only
    used[code] = True
    place = memory.places(words.dictionary.filter(pa.array(used)))[(np.cumsum(used) - 1)[code]]
    begin, n = memory.words.run(place)
    length = np.empty(len(first), np.int64)
    length[later], length[first] = n, sizes
    edge = np.concatenate(([0], np.cumsum(length)))
    out = np.empty(edge[-1], np.uint32)
    filled(out, edge[later], memory.words.ids, begin, n)
    filled(out, edge[offsets[:-1]], heads, np.cumsum(sizes) - sizes, sizes)
    return out, edge[offsets]


def together(batches, size: int):
    """Record batches, several made one until the texts in their second column have `size` bytes."""
    held, total = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        total += batch.column(1).nbytes
        if total >= size:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, total = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


