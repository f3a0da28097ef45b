"""One feature row per entity from events of hundreds of types (problem 5).

Each task keeps, for every event type, counts and totals as bit slices: compressed bitmaps over entity ordinals to which
a batch of events is added for all entities at once by carry addition. Latest times lie in an array in the order of the
ordinals. Decoding the slices gives the features of an entity.

An entity's events meet in one task, except for entities with more rows than a task should take: theirs are dealt over
all tasks by a hash of the whole event, counted there, and the tasks' slices are merged by carry addition too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tesselon.functions.bitmaps import TypeCounters
from tesselon.functions.keys import distinct_names
from tesselon.session import store_table

#: Rows of one entity from which on they are dealt over all tasks.
HOT_ROWS = 50_000
#: Entities that are dealt at most, those with most rows; any other has less than one row in so many of all.
HOT_MOST = 20_000
#: Hot entities in one row of slices, so that merging one type's slices takes bounded memory.
HOT_BLOCK = 512
#: Parts that an entity's rows are dealt into.
DEAL = 1024
#: Slices in one batch.
SLICE_ROWS = 256
#: Events gathered before they are added to the slices.
ADD_ROWS = 1_000_000

CELL = "struct<type_a:bigint,type_b:bigint,n:bigint,total:bigint,latest:bigint>"
_CELL = pa.struct([("type_a", pa.int64()), ("type_b", pa.int64()), ("n", pa.int64()), ("total", pa.int64()), ("latest", pa.int64())])


class _Counting:
    """The counters of one task, by event type (and, of hot entities, by block)."""

    def __init__(self) -> None:
        self.types: dict[tuple[int, ...], TypeCounters] = {}
        self.held: list[tuple[np.ndarray, ...]] = []
        self.rows = 0

    def take(self, at: np.ndarray, *columns: np.ndarray) -> None:
        """Ordinals, the columns of the type, and of each event its amount, time and weight."""
        self.held.append((at, *columns))
        self.rows += len(at)
        if self.rows >= ADD_ROWS:
            self.add()

    def add(self) -> None:
        if not self.rows:
            return
        at, *kind, amount, time, n = (np.concatenate(x) for x in zip(*self.held, strict=True))
        self.held, self.rows = [], 0
        order = np.lexsort(kind[::-1])
        at, amount, time, n, *kind = (x[order] for x in (at, amount, time, n, *kind))
        cuts = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in kind])) + 1
        for i, j in zip([0, *cuts], [*cuts, len(at)], strict=True):
            self.types.setdefault(tuple(int(k[i]) for k in kind), TypeCounters()).add_events(at[i:j], n[i:j], amount[i:j], time[i:j])


def _rows(types: dict[tuple[int, int], TypeCounters], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Decoded features, a row per entity with its cells by type."""
    if not types:
        return
    found = [(*c.decode(), np.full(len(c.seen), k[0]), np.full(len(c.seen), k[1])) for k, c in types.items()]
    at, n, total, latest, a, b = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((b, a, at))
    at, n, total, latest, a, b = (x[order] for x in (at, n, total, latest, a, b))
    starts = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    ends = np.append(starts[1:], len(at))
    for i in range(0, len(starts), 10_000):
        own, stop = starts[i : i + 10_000], ends[i : i + 10_000][-1]
        part = slice(own[0], stop)
        cells = pa.StructArray.from_arrays([pa.array(x[part]) for x in (a, b, n, total, latest)], fields=list(_CELL))
        offsets = pa.array(np.append(own, stop) - own[0], pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array([names[x] for x in at[own]], pa.string()), pa.ListArray.from_arrays(offsets, cells)], ["entity", "cells"])


#: What a task hands out: cells of ordinary entities, and slices of hot ones.
_COUNTED = pa.schema([("entity", pa.string()), ("cells", pa.list_(_CELL)), ("a", pa.int64()), ("b", pa.int64()), ("block", pa.int64()), ("slices", pa.binary())])
COUNTED = f"entity string, cells array<{CELL}>, a bigint, b bigint, block bigint, slices binary"


def _filled(batch: pa.RecordBatch) -> pa.RecordBatch:
    have = {batch.schema.names[k]: batch.column(k) for k in range(batch.num_columns)}
    return pa.RecordBatch.from_arrays([have[f.name] if f.name in have else pa.nulls(len(batch), f.type) for f in _COUNTED], schema=_COUNTED)


def entity_features(events: DataFrame, entity: Column, type_a: Column, type_b: Column, amount: Column, time: Column, *, distinct_by: tuple[str, ...] = (), entity_name: str = "entity", hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row per entity: ``(entity_name, cells)``; entities come out as strings.

    An event type is a pair of whole numbers. ``cells`` is an array of structs, one for each type the entity has, in the
    order of the types: ``type_a``, ``type_b``, ``n`` events, ``total`` of the whole, non-negative ``amount`` and the
    ``latest`` time. Types that an entity lacks stand for zeros. Rows with a null entity, type, amount or time are left
    out. With ``distinct_by``, rows equal in the entity and these columns are counted once, and type, amount and time
    must be functions of these columns. An empty table gives no rows; a negative amount raises. Other columns of
    ``events`` and their names have no influence.

    ``events`` is read twice, for the entities with at least ``hot_rows`` rows and for the features. Without
    ``distinct_by`` events of one entity and type are combined before the shuffle; with it they can't be, as copies may
    lie in different tasks, and one shuffle serves both their removal and the counting.
    """
    distinct_names(entity_name, "cells")
    entity = entity.cast("string")
    parts = {"_a": type_a, "_b": type_b, "_v": amount, "_t": time}
    cast = [c.cast("bigint").alias(n) for n, c in parts.items()]
    busy = events.select(entity.alias("_e")).where("_e is not null").groupBy("_e").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= hot_rows)
    hot = sorted(r["_e"] for r in busy.orderBy(F.desc("_n")).limit(HOT_MOST).collect())
    rows = events.select(entity.alias("_e"), *(distinct_by or cast)).where("_e is not null")
    deal = F.pmod(F.xxhash64(*(distinct_by or parts)), F.lit(DEAL)).cast("int") + 1
    # never a constant, which Spark would take out of the keys below, and shuffle again by all of them
    rows = rows.withColumn("_deal", F.when(F.col("_e").isin(hot), deal).otherwise(0) if hot else F.length("_e") * 0)
    if distinct_by:
        rows = rows.repartition("_e", "_deal").dropDuplicates(["_e", "_deal", *distinct_by]).select("_e", "_deal", *cast).dropna(subset=list(parts))
    else:
        rows = rows.dropna(subset=list(parts)).groupBy("_e", "_deal", "_a", "_b")
        negative = F.raise_error(F.lit("amounts must not be negative")).cast("bigint")
        rows = rows.agg(F.sum(F.when(F.col("_v") < 0, negative).otherwise(F.col("_v"))).alias("_v"), F.max("_t").alias("_t"), F.count(F.lit(1)).alias("_w"))
        rows = rows.repartition("_e", "_deal")
    ordinals = {name: i for i, name in enumerate(hot)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, dealt, names = _Counting(), _Counting(), {}
        for batch in batches:
            codes = batch.column(0).dictionary_encode()
            of_batch = codes.dictionary.to_pylist()
            code = codes.indices.to_numpy(zero_copy_only=False)
            columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(1, batch.num_columns)]
            if len(columns) == 5:  # events of weight 1
                columns.append(np.ones(len(code), np.int64))
            busy = np.flatnonzero(columns[0] > 0)
            rest = np.flatnonzero(columns[0] == 0)
            if len(rest):
                at = np.array([-1 if x in ordinals else names.setdefault(x, len(names)) for x in of_batch], dtype=np.int64)[code[rest]]
                own.take(at, *(c[rest] for c in columns[1:]))
            if len(busy):
                at = np.array([ordinals.get(x, -1) for x in of_batch], dtype=np.int64)[code[busy]]
                a, b, *values = (c[busy] for c in columns[1:])
                dealt.take(at % HOT_BLOCK, a, b, at // HOT_BLOCK, *values)
        own.add()
        dealt.add()
        yield from map(_filled, _rows(own.types, list(names)))
        keys = list(dealt.types)
        for i in range(0, len(keys), SLICE_ROWS):
            part = keys[i : i + SLICE_ROWS]
            kinds = [pa.array(c, pa.int64()) for c in zip(*part, strict=True)]
            yield _filled(pa.RecordBatch.from_arrays([*kinds, pa.array([dealt.types[k].dump() for k in part], pa.binary())], ["a", "b", "block", "slices"]))

    counted = rows.mapInArrow(count, COUNTED)
    if not hot:
        return counted.select(F.col("entity").alias(entity_name), "cells")
    counted = store_table(counted)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The slices of one type and block, which follow each other, into one."""
        last, whole = None, TypeCounters()
        for batch in batches:
            for *key, data in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if key != last:
                    if last is not None:
                        yield decoded(last, whole)
                    last, whole = key, TypeCounters()
                whole.merge(TypeCounters.load(data))
        if last is not None:
            yield decoded(last, whole)

    def decoded(key: list[int], whole: TypeCounters) -> pa.RecordBatch:
        seen, *values = whole.decode()
        cells = pa.StructArray.from_arrays([pa.array(np.full(len(seen), key[0])), pa.array(np.full(len(seen), key[1])), *map(pa.array, values)], fields=list(_CELL))
        return pa.RecordBatch.from_arrays([pa.array([hot[key[2] * HOT_BLOCK + i] for i in seen], pa.string()), cells], ["entity", "cell"])

    tasks = events.sparkSession.sparkContext.defaultParallelism  # not fewer, as the slices are small but their merging isn't
    slices = counted.where("slices is not null").select("a", "b", "block", "slices").repartition(tasks, "a", "b", "block").sortWithinPartitions("a", "b", "block")
    merged = slices.mapInArrow(merge, f"entity string, cell {CELL}").groupBy("entity").agg(F.array_sort(F.collect_list("cell")).alias("cells"))
    return counted.where("entity is not null").select("entity", "cells").unionByName(merged).withColumnRenamed("entity", entity_name)
