"""An FM-index over a sequence of words: suffix order, Burrows-Wheeler transform in a wavelet matrix, sampled positions."""

from __future__ import annotations

import numpy as np

#: Every so many-th position of the sequence is kept to locate occurrences.
SAMPLE = 16


class Bits:
    """Bits with ranks: words of 64 and the number of ones before each."""

    __slots__ = ("before", "words")

    def __init__(self, words: np.ndarray) -> None:
        self.words = words
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64)))

    @classmethod
    def of(cls, bits: np.ndarray) -> Bits:
        padded = np.zeros(((len(bits) >> 6) + 1) << 6, dtype=np.uint8)
        padded[: len(bits)] = bits
        return cls(np.packbits(padded, bitorder="little").view(np.uint64))

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word, bit = i >> 6, (i & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1)))

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) != 0


class WaveletMatrix:
    """Symbols below ``2 ** levels``, a level per bit from the highest, the zeros of a level in front of its ones."""

    def __init__(self, bits: list[Bits], zeros: list[int], largest: int) -> None:
        self.levels, self.bits, self.zeros = len(bits), bits, zeros
        self.base = self._walk(np.arange(largest + 1), np.zeros(largest + 1, np.int64))

    @classmethod
    def of(cls, symbols: np.ndarray, largest: int) -> WaveletMatrix:
        bits, zeros = [], []
        for level in range(max(1, int(largest).bit_length()) - 1, -1, -1):
            bit = (symbols >> level) & 1 == 1
            bits.append(Bits.of(bit))
            zeros.append(len(symbols) - int(bit.sum()))
            symbols = np.concatenate((symbols[~bit], symbols[bit]))
        return cls(bits, zeros, largest)

    def _walk(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for k, (bits, zeros) in enumerate(zip(self.bits, self.zeros, strict=True)):
            ones = bits.rank(i)
            i = np.where((symbol >> (self.levels - 1 - k)) & 1 == 1, zeros + ones, i - ones)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before the place beside it."""
        return self._walk(symbol, i) - self.base[symbol]

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place, and how often it occurs before."""
        symbol = np.zeros(len(i), np.int64)
        for bits, zeros in zip(self.bits, self.zeros, strict=True):
            one, ones = bits.get(i), bits.rank(i)
            symbol = symbol << 1 | one
            i = np.where(one, zeros + ones, i - ones)
        return symbol, i - self.base[symbol]


def suffix_order(symbols: np.ndarray, largest: int) -> np.ndarray:
    """The suffixes in order. Each 0 is an end mark of its own, less than all symbols and ordered by place; the last symbol is 0.

    First by as many symbols as fit into 63 bits, then by prefix doubling among those suffixes that are still tied.
    """
    n = len(symbols)
    marks = np.flatnonzero(symbols == 0)
    rest = np.flatnonzero(symbols != 0)
    width = max(1, int(largest).bit_length())
    depth = max(1, 63 // width)
    key = np.zeros(n, np.int64)
    open_ = np.ones(n, dtype=bool)  # no end mark so far
    for k in range(depth):
        shifted = np.concatenate((symbols[k:], np.zeros(min(k, n), symbols.dtype)))[:n]
        key = key << width | np.where(open_, shifted, 0)
        open_ &= shifted != 0
    order = rest[np.argsort(key[rest], kind="stable")]
    same = np.zeros(len(order) + 1, dtype=bool)
    same[1:-1] = (key[order[1:]] == key[order[:-1]]) & open_[order[1:]]
    slot = np.arange(len(order)) + len(marks)
    group = np.maximum.accumulate(np.where(same[:-1], 0, slot))
    rank = np.zeros(n, np.int64)
    rank[marks] = np.arange(len(marks))
    rank[order] = group
    tied = np.flatnonzero(same[:-1] | same[1:])
    reach = depth
    while len(tied):
        at = order[tied]
        mine, next_ = rank[at], rank[at + reach]
        by = np.lexsort((next_, mine))
        at, mine, next_ = at[by], mine[by], next_[by]
        order[tied] = at
        same = np.zeros(len(at) + 1, dtype=bool)
        same[1:-1] = (mine[1:] == mine[:-1]) & (next_[1:] == next_[:-1])
        group = np.maximum.accumulate(np.where(same[:-1], 0, tied + len(marks)))
        rank[at] = group
        tied = tied[same[:-1] | same[1:]]
        reach *= 2
    return np.concatenate((marks, order))


class FMIndex:
    """Finds phrases in a sequence of numbers from 1 to ``largest``, in which a 0 is an end mark that no phrase crosses."""

    def __init__(self, matrix: WaveletMatrix, counts: np.ndarray, kept: Bits, places: np.ndarray) -> None:
        self.matrix, self.counts, self.kept, self.places = matrix, counts, kept, places
        self.before = np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))  # symbols less than each
        self.size = int(self.before[-1])

    @classmethod
    def of(cls, symbols: np.ndarray, largest: int, sample: int = SAMPLE) -> FMIndex:
        symbols = np.append(np.asarray(symbols, dtype=np.int64), 0)
        order = suffix_order(symbols, largest)
        last = symbols[order - 1]  # for the suffix at place 0 this is the final end mark
        # walks backward stop at sampled places and never need to pass an end mark
        kept = (order % sample == 0) | (last == 0)
        return cls(WaveletMatrix.of(last, largest), np.bincount(symbols, minlength=largest + 1), Bits.of(kept), order[kept])

    def parts(self) -> dict[str, np.ndarray]:
        """The arrays that make the index up, for storing."""
        return {"bits": np.stack([b.words for b in self.matrix.bits]), "zeros": np.array(self.matrix.zeros), "counts": self.counts.astype(np.uint32), "kept": self.kept.words, "places": self.places.astype(np.uint32)}

    @classmethod
    def of_parts(cls, parts: dict[str, np.ndarray]) -> FMIndex:
        matrix = WaveletMatrix([Bits(w) for w in parts["bits"]], parts["zeros"].tolist(), len(parts["counts"]) - 1)
        return cls(matrix, parts["counts"].astype(np.int64), Bits(parts["kept"]), parts["places"].astype(np.int64))

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows [low, high) of each phrase; ``phrases`` holds a phrase per row, its last word first."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.size, np.int64)
        high[lengths == 0] = 0
        active = np.flatnonzero(lengths > 0)
        for step in range(int(lengths.max(initial=0))):
            active = active[(lengths[active] > step) & (high[active] > low[active])] if step else active
            if not len(active):
                break
            symbol = phrases[active, step]
            found = self.matrix.rank(np.concatenate((symbol, symbol)), np.concatenate((low[active], high[active])))
            low[active] = self.before[symbol] + found[: len(active)]
            high[active] = self.before[symbol] + found[len(active) :]
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The places in the sequence that belong to rows."""
        places, rows = np.zeros(len(rows), np.int64), rows.copy()
        left, steps = np.arange(len(rows)), 0
        while len(left):
            own = rows[left]
            there = self.kept.get(own)
            places[left[there]] = self.places[self.kept.rank(own[there])] + steps
            left = left[~there]
            symbol, before = self.matrix.access(rows[left])
            rows[left] = self.before[symbol] + before
            steps += 1
        return places
