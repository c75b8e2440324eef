"""FM-index of a shard of word sequences: suffix order, wavelet ranks, backward search, sampled suffix positions.

A shard is the concatenation of its sequences, each closed by a separator that sorts before every word and, among
separators, by its place; so no comparison of suffixes and no occurrence reaches beyond a sequence, and copies cost the
sorter as many doublings as their length has bits. The index is independent of what is searched in it.
"""

from __future__ import annotations

import numpy as np

from almanac.llm.packed import squeeze, unsqueeze

#: Every so many places of a shard, and each sequence's first, have their suffix position kept.
SAMPLE = 16


def suffix_order(s: np.ndarray, top: int, unique: int) -> np.ndarray:
    """Starts of the suffixes of ``s`` (numbers below ``top``) in order; numbers below ``unique`` occur once.

    The last number is unique. The first sort compares as many numbers as 63 bits hold; each later one sorts only what
    is still tied, by twice as many.
    """
    n, bits = len(s), max(1, int(top - 1).bit_length())
    width = max(1, 63 // bits)
    key = s.astype(np.int64)
    for k in range(1, width):
        key <<= bits
        key[: max(n - k, 0)] |= s[k:]
    order = np.argsort(key).astype(np.int32)
    key = key[order]
    first = np.append(True, key[1:] != key[:-1])
    del key
    place = np.maximum.accumulate(np.where(first, np.arange(n, dtype=np.int32), 0))
    rank = np.empty(n, np.int32)
    rank[order] = place
    tied = np.flatnonzero(~(first & np.append(first[1:], True)))
    while len(tied):
        own = order[tied]
        key = (rank[own].astype(np.int64) << 32) | rank[own + width]
        sort = np.argsort(key)
        own, key = own[sort], key[sort]
        order[tied] = own
        first = np.append(True, key[1:] != key[:-1])
        place = np.maximum.accumulate(np.where(first, tied, 0))
        rank[own] = place
        tied = tied[~(first & np.append(first[1:], True))]
        width *= 2
    return order


def _packed(bits: np.ndarray) -> np.ndarray:
    raw = np.packbits(bits, bitorder="little")
    return np.append(raw, np.zeros(-len(raw) % 8 + 8, np.uint8)).view(np.uint64)


class _Bits:
    """A bit vector with ranks."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.before = np.concatenate([np.zeros(1, np.int64), np.cumsum(np.bitwise_count(words), dtype=np.int64)])

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) != 0

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each of ``at``."""
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


def build(ids: np.ndarray, sizes: np.ndarray, words: list[bytes]) -> dict[str, bytes]:
    """The index of sequences of ``sizes`` numbers each of ``ids`` (places in ``words``), as compact columns."""
    many, total, size = len(sizes), len(words), np.asarray(sizes, np.int64)
    ends = np.cumsum(size + 1) - 1  # places of the separators
    n = int(ends[-1]) + 1
    s = np.empty(n, np.int32)
    held = np.ones(n, bool)
    held[ends] = False
    s[held], s[ends] = ids + many, np.arange(many, dtype=np.int32)
    order = suffix_order(s, many + total, many)
    start = np.zeros(n, bool)
    start[ends - size] = True
    begins = start[order]
    last = np.where(begins, 0, s[order - 1] - (many - 1)).astype(np.uint32)  # what precedes each suffix
    marked = begins | (order % SAMPLE == 0)
    levels = []
    for k in reversed(range(max(1, total.bit_length()))):
        bits = (last >> np.uint32(k)) & np.uint32(1) != 0
        levels.append(_packed(bits))
        last = np.concatenate([last[~bits], last[bits]])
    return {
        "words": b" ".join(words),
        "counts": squeeze(np.bincount(ids, minlength=total) if total else np.empty(0), "<u4"),
        "bits": np.concatenate(levels).tobytes(),
        "marks": _packed(marked).tobytes(),
        "places": squeeze(order[marked], "<u4"),
    }


class FmIndex:
    """The index that ``build`` made."""

    def __init__(self, sizes: np.ndarray, words: bytes, counts: bytes, bits: bytes, marks: bytes, places: bytes):
        self.sizes = np.asarray(sizes, np.int64)
        self.starts = np.cumsum(self.sizes + 1) - self.sizes - 1
        self.n = int(self.sizes.sum()) + len(self.sizes)
        self.symbols = {w: i for i, w in enumerate(words.split(b" "), 1)} if words else {}
        total = len(self.symbols)
        counts = np.concatenate([[len(self.sizes)], unsqueeze(counts, "<u4").astype(np.int64)])
        self.first = np.cumsum(counts) - counts  # suffixes that start with a lesser symbol
        self.levels = [_Bits(x) for x in np.frombuffer(bits, np.uint64).reshape(max(1, total.bit_length()), -1)]
        self.zeros = [self.n - int(x.before[-1]) for x in self.levels]
        self.marks, self.places = _Bits(np.frombuffer(marks, np.uint64)), unsqueeze(places, "<u4").astype(np.int64)

    def _down(self, symbol: np.ndarray, *at: np.ndarray) -> list[np.ndarray]:
        """Where the wavelet levels lead each of ``at`` by the bits of ``symbol``."""
        held = list(at)
        for level, (bits, zeros) in enumerate(zip(self.levels, self.zeros)):
            one = (symbol >> (len(self.levels) - 1 - level)) & 1 != 0
            for k, x in enumerate(held):
                r = bits.rank(x)
                held[k] = np.where(one, zeros + r, x - r)
        return held

    def find(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first, end) suffixes that start with each phrase, by backward search.

        ``phrases``: a row of symbols each, right-aligned; 0 is none of the shard's.
        """
        many, width = phrases.shape
        low, high = np.zeros(many, np.int64), np.full(many, self.n)
        held = (np.arange(width) >= width - lengths[:, None]) & (phrases == 0)
        high[held.any(1) | (lengths == 0)] = 0
        for k in reversed(range(width)):
            on = np.flatnonzero((low < high) & (lengths >= width - k))
            if not len(on):
                break
            symbol = phrases[on, k]
            distinct, at = np.unique(symbol, return_inverse=True)
            (base,) = self._down(distinct, np.zeros(len(distinct), np.int64))
            base = (self.first[distinct] - base)[at]
            a, b = self._down(symbol, low[on], high[on])
            low[on], high[on] = a + base, b + base
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes: steps back until one whose position is kept."""
        out, left, steps = np.empty(len(rows), np.int64), np.arange(len(rows)), 0
        while len(left):
            known = self.marks.get(rows)
            out[left[known]] = self.places[self.marks.rank(rows[known])] + steps
            rows, left, steps = rows[~known], left[~known], steps + 1
            symbol, zero = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
            for bits, zeros in zip(self.levels, self.zeros):
                one, r, z = bits.get(rows), bits.rank(rows), bits.rank(zero)
                symbol = 2 * symbol + one
                rows, zero = np.where(one, zeros + r, rows - r), np.where(one, zeros + z, zero - z)
            rows = rows - zero + self.first[symbol]
        return out
