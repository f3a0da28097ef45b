"""How often every distinct term occurs, and in how many records (problem 2): burst-trie counting."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tesselon.llm.burst_trie import BurstTrie, pack, unpack
from tesselon.session import cut_lineage

#: A prefix under which at least one part in so many of all container entries lies is heavy and routed by its next
#: character: a part for ROUTE_ENTRIES entries, but ROUTES_LEAST parts at least and ROUTES_MOST at most.
ROUTES_LEAST, ROUTES_MOST, ROUTE_ENTRIES = 1024, 65_536, 250_000
#: Characters by which prefixes grow in one round.
LEVELS = 8
#: Distinct terms that a task's trie holds before it is handed out and begun anew.
TRIE_TERMS = 500_000
#: Fixed value: the Java pattern for a run of white space.
SPACES = r"(?U)[\s\x1c-\x1f]+"


def normal_term(col: Column) -> Column:
    """Lower case, no white space at the ends, single spaces inside; null and blank become null."""
    text = F.trim(F.regexp_replace(F.lower(col), SPACES, " "))
    return F.when(text != "", text)


def _tries(batches: Iterator[pa.RecordBatch], most: int = TRIE_TERMS) -> Iterator[pa.RecordBatch]:
    """The containers of burst tries over (term, occurrences) rows, one row for each record that has the term.

    A trie is handed out when it holds ``most`` distinct terms, so a task's memory doesn't grow with its terms.
    """
    trie = BurstTrie()
    for batch in batches:
        found = pa.Table.from_batches([batch]).group_by("term").aggregate([("occ", "sum"), ("occ", "count")])
        for term, occurrences, records in zip(*(found[c].to_pylist() for c in ("term", "occ_sum", "occ_count")), strict=True):
            trie.add(term, occurrences, records)
        if trie.terms >= most:
            yield from _leaf_batches(trie)
            trie = BurstTrie()
    yield from _leaf_batches(trie)


def _leaf_batches(trie: BurstTrie) -> Iterator[pa.RecordBatch]:
    rows: list[tuple[str, int, bytes]] = []
    for path, container in trie.leaves():
        rows.append((path, len(container), pack(container)))
        if len(rows) == 1000:
            yield _leaf_batch(rows)
            rows = []
    if rows:
        yield _leaf_batch(rows)


def _leaf_batch(rows: list[tuple[str, int, bytes]]) -> pa.RecordBatch:
    path, entries, data = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(path, pa.string()), pa.array(entries, pa.int64()), pa.array(data, pa.binary())], ["path", "entries", "data"])


def _merge(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
    """All tasks' subtrees under one routing prefix as one trie, decoded."""
    trie = BurstTrie()
    for path, data in zip(part["path"], part["data"], strict=True):
        for suffix, (occurrences, records) in unpack(data).items():
            trie.add(path + suffix, occurrences, records)
    rows = [(path + suffix, *counters) for path, container in trie.leaves() for suffix, counters in container.items()]
    return pd.DataFrame(rows, columns=["term", "occurrences", "records"])


def heavy_prefixes(paths: DataFrame, total: int, parts: int) -> frozenset[str]:
    """The prefixes under which at least one part in ``parts`` of all entries lies, and ''; ``paths`` is (path, entries).

    They are looked for in rounds of ``LEVELS`` characters. A round looks only at paths under a heavy prefix of the full
    length of the round before and starts after what all its paths have in common, so long paths and long common
    beginnings cost no more rounds. Heavy prefixes come to the driver: those of one length are at most ``parts``.
    """
    heavy = {""}
    frontier = frozenset([""])
    while frontier:
        deepest = max(map(len, frontier))

        def grown(batches: Iterator[pa.RecordBatch], frontier=frontier, deepest=deepest) -> Iterator[pa.RecordBatch]:
            held: dict[str, list] = {}
            for batch in batches:
                for path, entries in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    start = longest_prefix(path, frontier, deepest)
                    for size in range(len(start) + 1, min(len(path), len(start) + LEVELS) + 1) if start is not None else ():
                        own = held.setdefault(path[:size], [size == len(start) + LEVELS, 0, path, path])
                        own[1:] = own[1] + entries, min(own[2], path), max(own[3], path)
                if len(held) >= 100_000:
                    yield _prefix_batch(held)
                    held = {}
            if held:
                yield _prefix_batch(held)

        found = paths.mapInArrow(grown, "prefix string, full boolean, n bigint, low string, high string").groupBy("prefix", "full").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
        rows = {r["prefix"]: r for r in found.where(F.col("n") * parts >= total).collect()}
        through = {p[:-1] for p, r in rows.items() if p[:-1] in rows and rows[p[:-1]]["n"] == r["n"]}  # nothing leaves there
        ends = {p: r["low"][: _common(r["low"], r["high"])] for p, r in rows.items()}
        heavy.update(ends[p] if rows[p]["full"] else p for p in rows.keys() - through)
        frontier = frozenset(ends[p] for p, r in rows.items() if r["full"] and r["low"] != r["high"])
    return frozenset(heavy)


def longest_prefix(text: str, prefixes: frozenset[str], most: int) -> str | None:
    """The longest of the prefixes, none longer than ``most``, with which a text begins."""
    return next((text[:k] for k in range(min(most, len(text)), -1, -1) if text[:k] in prefixes), None)


def _common(a: str, b: str) -> int:
    """How many characters two texts have in common at their beginnings."""
    return next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def _prefix_batch(held: dict[str, list]) -> pa.RecordBatch:
    full, n, low, high = zip(*held.values(), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(full, pa.bool_()), pa.array(n, pa.int64()), pa.array(low, pa.string()), pa.array(high, pa.string())], ["prefix", "full", "n", "low", "high"])


def term_counts(df: DataFrame, record: Column, terms: Column, *, min_records: int = 5, max_share: float = 0.1, routes: int | None = None, trie_terms: int = TRIE_TERMS) -> DataFrame:
    """One row per distinct term: ``(term, occurrences, records, mark)``.

    ``terms`` is an array of strings; its elements are compared in normal form (``normal_term``) and null or blank ones
    are none. ``record`` identifies a record, which may be landed in several rows: ``occurrences`` counts elements over
    all rows, ``records`` the distinct records with the term. Rows with a null record are left out; a null or empty array
    adds a record without terms. ``mark`` is 'rare' in fewer than ``min_records`` records, 'common' in more than
    ``max_share`` of all distinct records, else null ('rare' wins). An empty table gives no rows.

    Rows are first combined by record and term; each task then counts in burst tries of at most about ``trie_terms``
    terms. Entries of their containers are routed by prefixes that adapt to the data, of any length: the longest heavy
    one of a term (``heavy_prefixes``) and the character after it. Subtrees with one route are merged in one task, so a
    task merges about one part in ``routes`` of all entries.
    """
    rows = df.select(record.alias("_r"), terms.alias("_t")).where("_r is not null")
    n_records = rows.select("_r").distinct().count()
    element = rows.select("_r", F.explode("_t").alias("_e")).select("_r", normal_term(F.col("_e")).alias("term")).where("term is not null")
    pairs = element.groupBy("_r", "term").agg(F.count(F.lit(1)).alias("occ")).select("term", "occ")
    leaves = cut_lineage(pairs.mapInArrow(lambda batches: _tries(batches, trie_terms), "path string, entries bigint, data binary"))

    total = leaves.agg(F.sum("entries")).first()[0] or 0
    heavy = heavy_prefixes(leaves.where(F.length("path") > 0).select("path", "entries"), total, routes or min(ROUTES_MOST, max(ROUTES_LEAST, total // ROUTE_ENTRIES)))
    deepest = max(map(len, heavy))

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[str, str, bytes]] = []
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                parts: dict[str, dict[str, tuple[int, int]]] = {}
                for suffix, counters in unpack(data).items():
                    term = path + suffix
                    parts.setdefault(term[: len(longest_prefix(term, heavy, deepest)) + 1], {})[suffix] = counters
                out += [(to, path, pack(container)) for to, container in parts.items()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.string(), pa.string(), pa.binary()), strict=True)], ["route", "path", "data"])

    merged = leaves.select("path", "data").mapInArrow(routed, "route string, path string, data binary").groupBy("route").applyInPandas(_merge, "term string, occurrences bigint, records bigint")
    mark = F.when(F.col("records") < min_records, "rare").when(F.col("records") > max_share * n_records, "common")
    return merged.withColumn("mark", mark)
