"""Words of many texts at once: where they stand in the bytes, and 64-bit hashes of them."""

from __future__ import annotations

from itertools import chain

import numpy as np

from .common import mix64, random_words

BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
#: A random word for every byte value and odd powers of a random base for every place in a word.
_BYTE = random_words(101, 256)
_FOLDED = _BYTE.copy()
_FOLDED[65:91] = _BYTE[97:123]  # A-Z as a-z
_BASE = int(random_words(102, 1)[0]) | 1
_POWERS = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """The first n powers of the base, modulo 2**64."""
    global _POWERS
    if len(_POWERS) < n:
        size = max(n, 4096)
        _POWERS = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, _BASE, np.uint64)]), dtype=np.uint64)
    return _POWERS[:n]


def word_spans(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words (runs of bytes that are not ASCII white space), and the n+1 word offsets of the n texts."""
    solid = ~BLANK[body]
    edge = np.zeros(len(body) + 1, bool)
    edge[offsets] = True
    before = np.append(False, solid[:-1]) if len(solid) else solid
    after = np.append(solid[1:], False) if len(solid) else solid
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(body: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = False) -> np.ndarray:
    """A 64-bit hash of each span (none empty, none overlapping); ``fold`` takes A-Z as a-z."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    sizes = ends - starts
    upto = np.cumsum(sizes)
    place = np.arange(int(upto[-1])) - np.repeat(upto - sizes, sizes)
    terms = (_FOLDED if fold else _BYTE)[body[np.repeat(starts, sizes) + place]] * powers(int(sizes.max()))[place]
    return mix64(np.add.reduceat(terms, upto - sizes) + sizes.astype(np.uint64))


class CachedEncoder:
    """Ids of texts whose spans are encoded independently: each distinct span once, many kept for later slices."""

    def __init__(self, remember: int) -> None:
        self.remember = remember
        self.known = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)  # hash, first id, number of ids
        self.ids = np.zeros(1 << 20, np.uint32)
        self.used = 0

    def spans(self, body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return word_spans(body, offsets)

    def encode_new(self, words: list[bytes]) -> list[list[int]]:
        raise NotImplementedError

    def encode(self, body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (bytes end to end, with their offsets), and the n+1 offsets of the ids of each text."""
        starts, ends, of_text = self.spans(body, offsets)
        words, first, place = np.unique(span_hashes(body, starts, ends), return_index=True, return_inverse=True)
        hashes, at, sizes = self.known
        found = np.searchsorted(hashes, words)
        hit = found < len(hashes)
        hit[hit] = hashes[found[hit]] == words[hit]
        whole, new = body.tobytes(), np.flatnonzero(~hit)
        fresh = self.encode_new([whole[a:b] for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)])
        fresh_sizes = np.fromiter(map(len, fresh), np.int64, len(fresh))
        total = int(fresh_sizes.sum())
        if self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(total, len(self.ids)), np.uint32)])
        self.ids[self.used : self.used + total] = np.fromiter(chain.from_iterable(fresh), np.uint32, total)
        fresh_at = self.used + np.cumsum(fresh_sizes) - fresh_sizes
        word_at, word_sizes = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        word_at[hit], word_sizes[hit] = at[found[hit]], sizes[found[hit]]
        word_at[new], word_sizes[new] = fresh_at, fresh_sizes
        each = word_sizes[place]
        upto = np.append(0, np.cumsum(each))
        out = self.ids[np.repeat(word_at[place] - upto[:-1], each) + np.arange(int(upto[-1]))]
        if len(hashes) < self.remember:
            self.used += total
            # both are sorted, so the new ones are put between
            self.known = tuple(np.insert(k, found[new], v) for k, v in ((hashes, words[new]), (at, fresh_at), (sizes, fresh_sizes)))
        return out, upto[of_text]
