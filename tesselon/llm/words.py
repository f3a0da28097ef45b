"""Words of a text as they are compared between test material and training pages."""

from __future__ import annotations

import functools
import html
import re
import unicodedata
from collections.abc import Sequence

import numpy as np

TAG = re.compile(r"<!--.*?-->|</?[a-zA-Z][^<>]*>|<[!?][^<>]*>", re.DOTALL)
ENTITY = re.compile(r"&(?:#[0-9]{1,8};?|#[xX][0-9a-fA-F]{1,8};?|[A-Za-z][A-Za-z0-9]{1,31};?)")
#: Code points that can stand for something else than themselves: all but the plain Chinese blocks and unassigned planes.
_RANGES = ((0, 0x3400), (0x4DC0, 0x4E00), (0xA000, 0x20000), (0x2F800, 0x2FA20), (0xE0000, 0xE0200))
_DROP, _BREAK = 0, 1
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD1342543DE82EF95)


def _fold(char: str) -> str:
    """Compatibility forms made plain, without case, accents and invisible characters; other than letters and digits as \\x01."""
    kind = unicodedata.category(char)
    if kind in ("Cf", "Mn", "Me") or kind == "Cc" and not char.isspace():
        return ""
    plain = unicodedata.normalize("NFKD", unicodedata.normalize("NFKD", char).casefold())
    plain = "".join(c for c in plain if unicodedata.category(c) not in ("Cf", "Mn", "Me"))
    return "".join(c if unicodedata.category(c)[0] in "LN" else "\x01" for c in plain) or "\x01"


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per code point the number of code points it becomes and where they begin in the third array."""
    size, first, out = np.ones(0x110000, np.uint8), np.zeros(0x110000, np.uint32), []
    single = np.arange(0x110000, dtype=np.uint32)
    many: dict[int, str] = {}
    for low, high in _RANGES:
        for code in range(low, high):
            if 0xD800 <= code < 0xE000:
                single[code] = _BREAK
                continue
            folded = _fold(chr(code))
            if len(folded) == 1:
                single[code] = ord(folded)
            elif folded:
                many[code] = folded
            else:
                size[code] = 0
    first[:] = single
    for code, folded in many.items():
        size[code], first[code] = len(folded), 0x110000 + len(out)
        out += map(ord, folded)
    return size, first, np.array(out or [0], np.uint32)


def fold(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded code points, and for each the place in ``points`` that it comes from."""
    size, first, out = _tables()
    n = size[points]
    at = np.repeat(np.arange(len(points)), n)
    code = first[points][at]
    long = np.flatnonzero(code >= 0x110000)
    if len(long):
        step = np.concatenate(([0], np.cumsum(n.astype(np.int64))))
        code[long] = out[code[long] - 0x110000 + (long - step[at[long]])]
    return code, at


def plain(text: str) -> str:
    """Tags as spaces, then entities resolved."""
    if "<" in text:
        text = TAG.sub(" ", text)
    return html.unescape(text) if "&" in text else text


def _runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of all runs in a row, each from its start on."""
    return np.arange(int(sizes.sum())) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


class Words:
    """The words of some texts in a row: their characters, where each begins and ends there, a number made of each, its text."""

    def __init__(self, texts: Sequence[str]) -> None:
        texts = [plain(t) for t in texts]
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        raw = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.chars, self.origin = fold(raw)
        bounds = np.concatenate(([0], np.cumsum(lengths)))
        edges = np.searchsorted(self.origin, bounds)
        letter = np.zeros(len(self.chars) + 1, dtype=bool)
        letter[:-1] = self.chars != _BREAK
        edge = np.zeros(len(self.chars) + 1, dtype=bool)
        edge[edges] = True
        before = np.concatenate(([False], letter[:-1])) & ~edge
        self.starts = np.flatnonzero(letter & ~before)
        self.ends = np.flatnonzero(letter[:-1] & ~(letter & ~edge)[1:]) + 1
        self.text_starts = np.searchsorted(self.starts, edges)  # of each text the first word, and the end
        self.raw_bounds = bounds

    def numbers(self) -> np.ndarray:
        """A 64-bit number for each word, equal for equal words."""
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        sizes = self.ends - self.starts
        value = self.chars.astype(np.uint64) * _MIX
        value ^= value >> np.uint64(29)
        powers = np.cumprod(np.concatenate(([np.uint64(1)], np.full(int(sizes.max()), _BASE, np.uint64))))
        inside = self.inside()
        terms = value[inside] * powers[np.arange(len(inside)) - np.repeat(np.cumsum(sizes) - sizes, sizes)]
        return np.add.reduceat(terms, np.cumsum(sizes) - sizes) ^ (sizes.astype(np.uint64) << np.uint64(56))

    def inside(self) -> np.ndarray:
        """The places in ``chars`` of the characters of all words."""
        return _runs(self.starts, self.ends - self.starts)

    def word(self, i: int) -> str:
        return self.chars[self.starts[i] : self.ends[i]].tobytes().decode("utf-32-le")


class Vocabulary:
    """Distinct words, numbered from 1 in the order of the numbers made of them."""

    def __init__(self, numbers: np.ndarray, sizes: np.ndarray, chars: np.ndarray) -> None:
        self.numbers, self.sizes, self.chars = numbers, sizes, chars
        self.first = np.cumsum(sizes) - sizes

    @classmethod
    def of(cls, words: Words) -> tuple[Vocabulary, np.ndarray]:
        """The vocabulary of some texts, and the number of each of their words in it."""
        numbers, first, of_words = np.unique(words.numbers(), return_index=True, return_inverse=True)
        sizes = (words.ends - words.starts)[first]
        return cls(numbers, sizes, words.chars[_runs(words.starts[first], sizes)]), of_words + 1

    def __len__(self) -> int:
        return len(self.numbers)

    def find(self, other: Vocabulary) -> np.ndarray:
        """Of each word of another vocabulary its number here, or 0; characters are compared, not only the numbers made of them."""
        if not len(self) or not len(other):
            return np.zeros(len(other), np.int64)
        at = np.minimum(np.searchsorted(self.numbers, other.numbers), len(self) - 1)
        same = (self.numbers[at] == other.numbers) & (self.sizes[at] == other.sizes)
        own = np.flatnonzero(same)
        if len(own):
            size = other.sizes[own]
            equal = other.chars[_runs(other.first[own], size)] == self.chars[_runs(self.first[at[own]], size)]
            same[own] = np.logical_and.reduceat(equal, np.cumsum(size) - size)
        return np.where(same, at + 1, 0)

    def parts(self) -> dict[str, np.ndarray]:
        """The arrays that make the vocabulary up, for storing."""
        text = self.chars.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
        return {"numbers": self.numbers, "sizes": self.sizes.astype(np.uint32), "chars": np.frombuffer(text, np.uint8)}

    @classmethod
    def of_parts(cls, parts: dict[str, np.ndarray]) -> Vocabulary:
        text = parts["chars"].tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass")
        return cls(parts["numbers"], parts["sizes"].astype(np.int64), np.frombuffer(text, np.uint32))


def word_offsets(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Where each word of ``Words([text])`` begins and ends in the text as stored."""
    made: list[str] = []
    origin: list[np.ndarray] = []
    ends: list[np.ndarray] = []

    def keep(part: str, start: int) -> None:
        at = 0
        for m in ENTITY.finditer(part):
            became = html.unescape(m[0])
            if became == m[0]:
                continue
            made.extend((part[at : m.start()], became))
            here = np.arange(start + at, start + m.start())
            origin.extend((here, np.full(len(became), start + m.start())))
            ends.extend((here + 1, np.full(len(became), start + m.end())))
            at = m.end()
        made.append(part[at:])
        origin.append(np.arange(start + at, start + len(part)))
        ends.append(origin[-1] + 1)

    at = 0
    for m in TAG.finditer(text):
        keep(text[at : m.start()], at)
        made.append(" ")
        origin.append(np.array([m.start()]))
        ends.append(np.array([m.end()]))
        at = m.end()
    keep(text[at:], at)
    raw = np.frombuffer("".join(made).encode("utf-32-le", "surrogatepass"), np.uint32)
    origins, stops = np.concatenate(origin).astype(np.int64), np.concatenate(ends).astype(np.int64)
    chars, source = fold(raw)
    letter = np.concatenate((chars != _BREAK, [False]))
    starts = np.flatnonzero(letter & ~np.concatenate(([False], letter[:-1])))
    last = np.flatnonzero(letter[:-1] & ~letter[1:])
    return origins[source[starts]], stops[source[last]]
