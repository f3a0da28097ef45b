"""Compressed bitmaps and bit-sliced counters over entity ordinals."""

from __future__ import annotations

import struct

import numpy as np

#: A container of up to 65,536 ordinals is a sorted array below this many entries and a set of bits from there on.
DENSE_FROM = 4096
_WORDS = 1024
_BIT = np.uint64(1) << np.arange(64, dtype=np.uint64)


def _to_bits(low: np.ndarray) -> np.ndarray:
    bits = np.zeros(65536, dtype=np.uint8)
    bits[low] = 1
    return np.packbits(bits, bitorder="little").view(np.uint64)


def _from_bits(words: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(words.view(np.uint8), bitorder="little")).astype(np.uint16)


def _settle(x: np.ndarray) -> np.ndarray:
    """The smaller of the two forms of a container."""
    if x.dtype == np.uint64:
        return _from_bits(x) if int(np.bitwise_count(x).sum()) < DENSE_FROM else x
    return _to_bits(x) if len(x) >= DENSE_FROM else x


def _xor(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if a.dtype == np.uint16 and b.dtype == np.uint16:
        return _settle(np.setxor1d(a, b, assume_unique=True))
    return _settle((a if a.dtype == np.uint64 else _to_bits(a)) ^ (b if b.dtype == np.uint64 else _to_bits(b)))


def _and(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if a.dtype == np.uint16 and b.dtype == np.uint16:
        return np.intersect1d(a, b, assume_unique=True)
    if a.dtype == np.uint64 and b.dtype == np.uint64:
        return _settle(a & b)
    low, words = (a, b) if a.dtype == np.uint16 else (b, a)
    return low[(words[low >> 6] & _BIT[low & 63]) != 0]


class Bitmap:
    """A set of ordinals below 2**48, kept as containers by the bits above the lowest sixteen."""

    __slots__ = ("parts",)

    def __init__(self, parts: dict[int, np.ndarray] | None = None) -> None:
        self.parts = parts or {}

    @classmethod
    def of(cls, ordinals: np.ndarray) -> Bitmap:
        """From ascending distinct ordinals."""
        ordinals = np.asarray(ordinals, dtype=np.int64)
        if not len(ordinals):
            return cls()
        high = ordinals >> 16
        cuts = np.flatnonzero(high[1:] != high[:-1]) + 1
        return cls({int(part[0] >> 16): _settle((part & 0xFFFF).astype(np.uint16)) for part in np.split(ordinals, cuts)})

    def ordinals(self) -> np.ndarray:
        parts = [(low if low.dtype == np.uint16 else _from_bits(low)).astype(np.int64) + (high << 16) for high, low in sorted(self.parts.items())]
        return np.concatenate(parts) if parts else np.zeros(0, np.int64)

    def __bool__(self) -> bool:
        return bool(self.parts)

    def __xor__(self, other: Bitmap) -> Bitmap:
        out = dict(self.parts)
        for high, low in other.parts.items():
            merged = _xor(out[high], low) if high in out else low
            if len(merged):
                out[high] = merged
            else:
                out.pop(high)
        return Bitmap(out)

    def __and__(self, other: Bitmap) -> Bitmap:
        out = {high: _and(low, other.parts[high]) for high, low in self.parts.items() if high in other.parts}
        return Bitmap({high: low for high, low in out.items() if len(low)})

    def dump(self) -> bytes:
        blocks = [struct.pack("<I", len(self.parts))]
        for high, low in sorted(self.parts.items()):
            blocks += [struct.pack("<QHI", high, int(low.dtype == np.uint64), len(low)), low.tobytes()]
        return b"".join(blocks)

    @classmethod
    def load(cls, data: bytes, at: int = 0) -> tuple[Bitmap, int]:
        (n,), at, parts = struct.unpack_from("<I", data, at), at + 4, {}
        for _ in range(n):
            high, dense, size = struct.unpack_from("<QHI", data, at)
            at += 14
            kind = np.dtype(np.uint64 if dense else np.uint16)
            parts[high] = np.frombuffer(data, dtype=kind, count=size, offset=at)
            at += size * kind.itemsize
        return cls(parts), at


class SlicedCounter:
    """Non-negative counters of many ordinals at once: slice ``j`` is the bitmap of the ordinals whose counter has bit ``j``."""

    __slots__ = ("slices",)

    def __init__(self, slices: list[Bitmap] | None = None) -> None:
        self.slices = slices or []

    @classmethod
    def of(cls, ordinals: np.ndarray, amounts: np.ndarray) -> SlicedCounter:
        """From ascending distinct ordinals and an amount for each."""
        amounts = np.asarray(amounts, dtype=np.int64)
        if len(amounts) and amounts.min() < 0:
            raise ValueError("amounts must not be negative")
        top = int(amounts.max()).bit_length() if len(amounts) else 0
        return cls([Bitmap.of(ordinals[(amounts >> j) & 1 == 1]) for j in range(top)])

    def add(self, other: SlicedCounter) -> None:
        """Carry addition, slice by slice, of all counters at once."""
        carry = Bitmap()
        for j in range(max(len(self.slices), len(other.slices))):
            a = self.slices[j] if j < len(self.slices) else Bitmap()
            b = other.slices[j] if j < len(other.slices) else Bitmap()
            either = a ^ b
            total = either ^ carry
            # the two carries are disjoint, so their exclusive or is their union
            carry = (a & b) ^ (either & carry) if (a and b) or carry else Bitmap()
            if j < len(self.slices):
                self.slices[j] = total
            else:
                self.slices.append(total)
        if carry:
            self.slices.append(carry)

    def decode(self, ordinals: np.ndarray) -> np.ndarray:
        """The counters of ascending ordinals, among which all counted ones must be."""
        out = np.zeros(len(ordinals), dtype=np.int64)
        for j, bits in enumerate(self.slices):
            out[np.searchsorted(ordinals, bits.ordinals())] += 1 << j
        return out

    def dump(self) -> bytes:
        return struct.pack("<H", len(self.slices)) + b"".join(x.dump() for x in self.slices)

    @classmethod
    def load(cls, data: bytes, at: int = 0) -> tuple[SlicedCounter, int]:
        (n,), at, slices = struct.unpack_from("<H", data, at), at + 2, []
        for _ in range(n):
            bits, at = Bitmap.load(data, at)
            slices.append(bits)
        return cls(slices), at


class TypeCounters:
    """Of one event type: counts and totals as bit slices over ordinals, and latest times in the order of the ordinals that occur."""

    __slots__ = ("counts", "latest", "seen", "totals")

    def __init__(self) -> None:
        self.counts, self.totals = SlicedCounter(), SlicedCounter()
        self.seen, self.latest = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _times(self, ordinals: np.ndarray, latest: np.ndarray) -> None:
        seen = np.union1d(self.seen, ordinals)
        times = np.full(len(seen), np.iinfo(np.int64).min)
        times[np.searchsorted(seen, self.seen)] = self.latest
        at = np.searchsorted(seen, ordinals)
        times[at] = np.maximum(times[at], latest)
        self.seen, self.latest = seen, times

    def add_events(self, ordinals: np.ndarray, weights: np.ndarray, amounts: np.ndarray, times: np.ndarray) -> None:
        """Events of the ordinals; a weight is the number of events that a row stands for, with their amounts' sum and latest time."""
        order = np.lexsort((times, ordinals))
        ordinals, weights, amounts, times = ordinals[order], weights[order], amounts[order], times[order]
        starts = np.flatnonzero(np.concatenate(([True], ordinals[1:] != ordinals[:-1])))
        ends = np.append(starts[1:], len(ordinals))
        own = ordinals[starts]
        self.counts.add(SlicedCounter.of(own, np.add.reduceat(weights, starts)))
        self.totals.add(SlicedCounter.of(own, np.add.reduceat(amounts, starts)))
        self._times(own, times[ends - 1])

    def merge(self, other: TypeCounters) -> None:
        self.counts.add(other.counts)
        self.totals.add(other.totals)
        self._times(other.seen, other.latest)

    def decode(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        return self.seen, self.counts.decode(self.seen), self.totals.decode(self.seen), self.latest

    def dump(self) -> bytes:
        return struct.pack("<I", len(self.seen)) + self.seen.tobytes() + self.latest.tobytes() + self.counts.dump() + self.totals.dump()

    @classmethod
    def load(cls, data: bytes) -> TypeCounters:
        out, (n,) = cls(), struct.unpack_from("<I", data)
        out.seen = np.frombuffer(data, np.int64, n, 4)
        out.latest = np.frombuffer(data, np.int64, n, 4 + 8 * n)
        out.counts, at = SlicedCounter.load(data, 4 + 16 * n)
        out.totals, _ = SlicedCounter.load(data, at)
        return out
