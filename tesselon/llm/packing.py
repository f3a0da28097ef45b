"""Documents into containers of a fixed number of tokens (problem 6): best-two-fit."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tesselon.functions.keys import distinct_names
from tesselon.llm.tokens import count_tokens, slices
from tesselon.session import cut_lineage

CAPACITY = 2048
#: Containers that one task packs, about; each task leaves at most a few containers that aren't full.
CONTAINERS_A_TASK = 4096


def text_sizes(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id_col, tokens)`` for every row; a null text has no tokens."""
    distinct_names(id_col, "tokens")
    id_type = df.schema[id_col].dataType.simpleString()

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 1)):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(count_tokens(batch.column(1)), pa.int64())], ["id", "tokens"])

    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(sizes, f"id {id_type}, tokens bigint").withColumnRenamed("id", id_col)


def best_two_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container number of each item; sizes are 0 to ``capacity``.

    A container is filled greedily with the largest item that fits. Then its smallest item is taken out again if two
    other unpacked items fill the room it leaves better than it did; among such pairs the fullest is taken, and the step
    is repeated while it gains. Items without size go to container 0.
    """
    out = np.zeros(len(sizes), dtype=np.int64)
    order = np.argsort(-sizes, kind="stable")
    piles: dict[int, list[int]] = {}
    for i in order[::-1].tolist():
        if size := int(sizes[i]):
            piles.setdefault(size, []).append(i)
    there = 0  # bit s is set while an unpacked item has size s
    for size in piles:
        there |= 1 << size
    upto = [(1 << (g + 1)) - 1 for g in range(capacity + 1)]

    def take(size: int) -> int:
        nonlocal there
        pile = piles[size]
        i = pile.pop()
        if not pile:
            there &= ~(1 << size)
        return i

    def give(size: int, i: int) -> None:
        nonlocal there
        piles[size].append(i)
        there |= 1 << size

    def two(room: int, least: int) -> tuple[int, int] | None:
        """The sizes of two unpacked items that fill most of ``room``, and more than ``least`` of it."""
        best, found = least, None
        large = (there & upto[room - 1]).bit_length() - 1 if room > 1 else 0
        while large > 0 and 2 * large > best:
            small = (there & upto[min(large, room - large)]).bit_length() - 1
            if small == large and len(piles[large]) < 2:
                small = (there & upto[small - 1]).bit_length() - 1
            if small > 0 and large + small > best:
                best, found = large + small, (large, small)
                if best == room:
                    break
            large = (there & upto[large - 1]).bit_length() - 1
        return found

    number = 0
    while there:
        held: list[tuple[int, int]] = []
        gap = capacity
        while gap > 0 and (size := (there & upto[gap]).bit_length() - 1) > 0:
            held.append((size, take(size)))
            gap -= size
        while gap > 0 and there:
            at = min(range(len(held)), key=lambda k: held[k][0])
            size, i = held[at]
            pair = two(gap + size, size)
            if pair is None:
                break
            held[at] = (pair[0], take(pair[0]))
            held.append((pair[1], take(pair[1])))
            give(size, i)
            gap += size - sum(pair)
        for _, i in held:
            out[i] = number
        number += 1
    return out


def pack(sizes: DataFrame, id_col: str, size_col: str, capacity: int = CAPACITY, containers_a_task: int = CONTAINERS_A_TASK) -> DataFrame:
    """``(id_col, piece, first, size, container)``: every item in one container, or split only if longer than one.

    An item longer than ``capacity`` is cut into pieces 0, 1, ... that fill a container each, and a rest; ``first`` is the
    item's unit at which the piece begins. Sizes of null count as 0, negative ones raise; an item without size still comes
    out, in a container with room for nothing more or less. Rows with the same id are items of their own. An empty table
    gives no rows. No container holds more than ``capacity``.

    Items are dealt by hash to tasks that pack about ``containers_a_task`` containers each, so the room lost by packing
    apart is a part of about one in so many. Only ids and sizes are moved.
    """
    distinct_names(id_col, "piece", "first", "size", "container")
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    id_type = sizes.schema[id_col].dataType.simpleString()
    rows = sizes.select(F.col(id_col).alias("id"), F.coalesce(F.col(size_col).cast("bigint"), F.lit(0)).alias("all"))
    total, least = rows.agg(F.sum("all"), F.min("all")).first()
    if least is not None and least < 0:
        raise ValueError("sizes must not be negative")
    tasks = max(1, -(-(total or 0) // (capacity * containers_a_task)))
    first = F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("all") - 1, F.lit(0)), F.lit(capacity).cast("bigint")))
    pieces = rows.select("id", "all", first.alias("first")).select("id", F.col("first"), (F.col("first") / capacity).cast("bigint").alias("piece"), F.least(F.col("all") - F.col("first"), F.lit(capacity)).alias("size"))

    def one(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["size", "id", "piece"], kind="stable", ignore_index=True)
        number = best_two_fit(part["size"].to_numpy(), capacity)
        return part[["id", "piece", "first", "size"]].assign(container=number + (int(key[0]) << 32))

    dealt = pieces.withColumn("task", F.pmod(F.xxhash64("id", "piece"), F.lit(tasks)).cast("bigint"))
    return dealt.groupBy("task").applyInPandas(one, f"id {id_type}, piece bigint, first bigint, size bigint, container bigint").withColumnRenamed("id", id_col)


def pack_texts(df: DataFrame, id_col: str, text_col: str, capacity: int = CAPACITY, containers_a_task: int = CONTAINERS_A_TASK) -> DataFrame:
    """``pack`` over the sizes of texts in tokens, which are counted once and kept in the shared folder."""
    return pack(cut_lineage(text_sizes(df, id_col, text_col)), id_col, "tokens", capacity, containers_a_task)
