"""Texts of an Arrow batch as one array of code points, and the words of the public BERT tokenizer in it."""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The symbols beside punctuation that stand alone, and the ranges of Chinese characters, which do too.
ALONE = "$+<=>^`|~"
CHINESE = ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF))
SPACE, SINGLE, RUN = 0, 1, 2


@functools.cache
def token_classes() -> np.ndarray:
    """For every code point: white space, a token by itself, or part of a run."""
    table = np.full(0x110000, RUN, dtype=np.uint8)
    for code in range(0x110000):
        kind = unicodedata.category(chr(code))[0]
        if kind == "Z":
            table[code] = SPACE
        elif kind == "P":
            table[code] = SINGLE
    table[[ord(c) for c in " \t\n\x0b\x0c\r"]] = SPACE
    table[[ord(c) for c in ALONE]] = SINGLE
    for first, last in CHINESE:
        table[first : last + 1] = SINGLE
    return table


def code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts' code points in a row, and where each text starts in it (and the last one ends); null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if offsets is not None and len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    before = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    return np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32), before[offsets - offsets[0]]


def slices(batch: pa.RecordBatch, column: int, size: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """The batch in parts whose texts have about ``size`` bytes at most (a longer text is a part of its own), to bound memory."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = (np.cumsum(lengths, dtype=np.int64) - 1) // size if len(lengths) else lengths
    cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1), len(batch)]
    for i, j in zip(cuts, cuts[1:], strict=False):
        if j > i:
            yield batch.slice(i, j - i)


def token_starts(points: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places at which tokens start and, in the same order, those at which they end; no token crosses a bound."""
    kind = token_classes()[points]
    run = kind == RUN
    edge = np.zeros(len(points) + 1, dtype=bool)
    edge[bounds] = True
    starts, ends = kind == SINGLE, kind == SINGLE
    goes_on = np.zeros(len(points) + 1, dtype=bool)
    goes_on[1:-1] = run[1:] & run[:-1]
    goes_on &= ~edge
    starts = starts | run & ~goes_on[:-1]
    ends = ends | run & ~goes_on[1:]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def count_tokens(texts: pa.Array) -> np.ndarray:
    """The size of each text in tokens."""
    points, bounds = code_points(texts)
    starts, _ = token_starts(points, bounds)
    return np.diff(np.searchsorted(starts, bounds))
