"""A burst trie with two counters per term, and its compact form."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np

#: A container with more terms than this bursts into a node with one container per next character.
BURST = 128


class BurstTrie:
    """Inner nodes are dicts from a character to a subtree; leaves are containers, dicts from a suffix to its counters."""

    __slots__ = ("burst", "root", "terms")

    def __init__(self, burst: int = BURST) -> None:
        self.burst, self.root, self.terms = burst, _Leaf(), 0

    def add(self, term: str, occurrences: int, records: int) -> None:
        node, parent, depth = self.root, None, 0
        while type(node) is _Node:
            parent = node
            if depth == len(term):
                own = node.own
                self.terms += own is None
                node.own = (occurrences, records) if own is None else (own[0] + occurrences, own[1] + records)
                return
            child = node.next.get(term[depth])
            if child is None:
                child = node.next[term[depth]] = _Leaf()
            node, depth = child, depth + 1
        suffix = term[depth:]
        had = node.get(suffix)
        self.terms += had is None
        node[suffix] = (occurrences, records) if had is None else (had[0] + occurrences, had[1] + records)
        if len(node) > self.burst:
            burst = _burst(node)
            if parent is None:
                self.root = burst
            else:
                parent.next[term[depth - 1]] = burst

    def leaves(self) -> Iterator[tuple[str, dict[str, tuple[int, int]]]]:
        """The containers with the path that leads to each; a term that ends at an inner node is a container of its own."""
        stack = [("", self.root)]
        while stack:
            path, node = stack.pop()
            if type(node) is _Leaf:
                if node:
                    yield path, node
                continue
            if node.own is not None:
                yield path, {"": node.own}
            stack.extend((path + c, child) for c, child in node.next.items())


class _Leaf(dict):
    pass


class _Node:
    __slots__ = ("next", "own")

    def __init__(self) -> None:
        self.next, self.own = {}, None


def _burst(leaf: _Leaf) -> _Node:
    node = _Node()
    for suffix, counters in leaf.items():
        if suffix:
            node.next.setdefault(suffix[0], _Leaf())[suffix[1:]] = counters
        else:
            node.own = counters
    return node


def pack(container: dict[str, tuple[int, int]]) -> bytes:
    """A container's suffixes in order, their lengths and counters, compressed."""
    suffixes = sorted(container)
    numbers = np.array([(len(s), *container[s]) for s in suffixes], dtype=np.int64).T
    return zlib.compress(struct.pack("<I", len(suffixes)) + numbers.tobytes() + "".join(suffixes).encode("utf-8", "surrogatepass"), 1)


def unpack(data: bytes) -> dict[str, tuple[int, int]]:
    data = zlib.decompress(data)
    (n,) = struct.unpack_from("<I", data)
    lengths, occurrences, records = np.frombuffer(data, np.int64, 3 * n, 4).reshape(3, n).tolist()
    text, out, at = data[4 + 24 * n :].decode("utf-8", "surrogatepass"), {}, 0
    for size, o, r in zip(lengths, occurrences, records, strict=True):
        out[text[at : at + size]] = (o, r)
        at += size
    return out
