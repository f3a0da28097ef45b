"""Positions within a key that don't put a busy key's rows into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tesselon.session import store_table


def add_position(df: DataFrame, key: str, order: Sequence[Column], slot: Column, position: str = "_pos", count: str = "_cnt") -> DataFrame:
    """``df`` with each row's position (from 1) within its key and the key's number of rows.

    ``slot`` must rise with ``order``: all rows of a lesser slot (null first) come before those of a greater one. Counts
    of (key, slot) give the rows before a slot, and only the rows of one slot are ordered in one task; so a key of any
    size is spread over as many tasks as it has slots. Ties are broken by ``order`` alone. Rows with a null key are left
    out. An empty table stays empty.
    """
    rows = df.where(F.col(key).isNotNull()).withColumn("_slot", F.coalesce(slot.cast("bigint"), F.lit(-(2**62))))
    sizes = rows.groupBy(key, "_slot").agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(key)
    before = whole.orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(F.col(key).alias("_k"), F.col("_slot").alias("_s"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(whole).alias(count))
    placed = rows.join(sizes, (F.col(key) == F.col("_k")) & (F.col("_slot") == F.col("_s")))
    within = F.row_number().over(Window.partitionBy(key, "_slot").orderBy(*order))
    return placed.withColumn(position, F.col("_before") + within).drop("_k", "_s", "_slot", "_before")


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, position: str = "rank") -> DataFrame:
    """The first ``k`` rows of each key in ``order``, with their positions; Spark keeps only ``k`` rows a key before the shuffle."""
    if k <= 0:
        return df.withColumn(position, F.lit(0)).limit(0)
    return df.withColumn(position, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(position) <= k)


def stable_order(seed: int, *keys: Column) -> Column:
    """A pseudo-random order that any engine can repeat: the md5 of seed and keys."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys]))


def sample_exactly(df: DataFrame, n: int | None, seed: int, *keys: Column) -> DataFrame:
    """Exactly ``n`` rows (all, if there are no more or ``n`` is None), chosen by ``stable_order`` of the keys.

    Rows whose order is beyond a bound, below which somewhat more than ``n`` lie, are left out before the others are
    ordered, so a task hands on its share of the ``n`` rows and not ``n`` of its own. The rows are counted for the bound.
    """
    if n is None:
        return df
    if n < 0:
        raise ValueError("n must not be negative")
    total = df.count()
    if n >= total:
        return df
    place = stable_order(seed, *keys)
    ordered = lambda rows: rows.orderBy(place, *keys).limit(n)
    bound = int((n + 6 * n**0.5 + 50) / total * 16**12)
    if bound < 16**12:
        below = df.where(place < f"{bound:012x}")
        if below.count() >= n:
            return ordered(below)
    return ordered(df)  # keys that repeat can share one place


def numbered(df: DataFrame, number: str, *order: Column) -> DataFrame:
    """``df`` with each row's number in ``order``, from 0; stored, so numbers stay.

    Ranges of rows are ordered in tasks of their own and counted, and the counts give the number a range begins with, so
    no task orders all rows, however many are equal in a part of the order.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    ranged = store_table(ranged)  # a partition's number is in the upper bits of _at
    sizes = ranged.groupBy(F.shiftright("_at", 33).alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_part", before.alias("_before"))  # a row for each task that wrote
    placed = ranged.join(F.broadcast(starts), F.shiftright("_at", 33) == F.col("_part"))
    return placed.withColumn(number, F.col("_before") + F.col("_at").bitwiseAND(F.lit(2**33 - 1))).select(*df.columns, number)


def number_keys(df: DataFrame, key: str, number: str) -> DataFrame:
    """``(key, number)``: the distinct keys that aren't null, numbered from 0 in their order."""
    return numbered(df.select(key).where(F.col(key).isNotNull()).distinct(), number, F.col(key))
