"""Per-key results where a few keys hold most records (problem 1).

Value-frequency compression: rows are first grouped by key *and* value, with map-side combine, so a key that holds a
third of all rows shrinks to one weighted row per distinct value before anything is grouped by key alone. Counts, exact
distinct counts, means, modes and percentiles then come from the weighted values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tesselon.functions.keys import distinct_names
from tesselon.session import store_table

#: Different values of one key up to which one task adds them up for percentiles.
WINDOW_VALUES = 200_000


def value_frequencies(df: DataFrame, key: Column, value: Column) -> DataFrame:
    """``(_key, _value, _n)``: how often each value occurs with each key.

    Null keys and null values are groups of their own; an empty table gives no rows. Names in ``df`` can't clash, as only
    the two expressions are kept. The shuffle is by key and value, with partial counts made before it.
    """
    return df.select(key.alias("_key"), value.alias("_value")).groupBy("_key", "_value").agg(F.count(F.lit(1)).alias("_n"))


def key_profile(df: DataFrame, key: Column, value: Column, *, key_name: str = "key", percentiles: Sequence[float] = (), window_values: int = WINDOW_VALUES) -> DataFrame:
    """One row per key, complete for every key however many rows it has.

    Columns: ``key_name``, ``n_rows``, ``n_valued`` (rows whose value is not null), ``n_distinct`` (exact), ``mean``,
    ``mode`` (the most frequent value, the smallest of ties), ``mode_count``, ``minimum``, ``maximum`` and
    ``percentiles``, an array in the order asked for: the least value at or below which that share of the key's valued
    rows lies. ``mean`` is null unless values are numbers. A null key is a key; a key with only null values has
    ``n_distinct`` 0 and null statistics; an empty table gives an empty result.

    With ``percentiles`` the weighted values are kept as a table. If no key has more than ``window_values`` of them, they
    are added up key by key; else in ranges of (key, value) of about equal size, so no task sees a whole key.
    """
    if any(not 0 < p <= 1 for p in percentiles):
        raise ValueError("percentiles must lie in (0, 1]")
    distinct_names(key_name, "n_rows", "n_valued", "n_distinct", "mean", "mode", "mode_count", "minimum", "maximum", "percentiles")
    freq = value_frequencies(df, key, value)
    if percentiles:
        freq = store_table(freq)
    has = F.col("_value").isNotNull()
    numeric = freq.schema["_value"].dataType.typeName() in ("double", "float", "long", "integer", "short", "byte") or "decimal" in freq.schema["_value"].dataType.typeName()
    mean = F.sum(F.col("_value").cast("double") * F.col("_n")) / F.sum(F.when(has, F.col("_n"))) if numeric else F.lit(None).cast("double")
    best = F.max(F.when(has, F.col("_n")))
    out = freq.groupBy("_key").agg(
        F.sum("_n").alias("n_rows"),
        F.coalesce(F.sum(F.when(has, F.col("_n"))), F.lit(0)).cast("bigint").alias("n_valued"),
        F.count("_value").alias("n_distinct"),
        mean.alias("mean"),
        F.min_by("_value", F.when(has, F.struct(-F.col("_n"), F.col("_value")))).alias("mode"),
        best.alias("mode_count"),
        F.min("_value").alias("minimum"),
        F.max("_value").alias("maximum"),
    )
    if percentiles:
        most = freq.where(has).groupBy("_key").agg(F.count(F.lit(1)).alias("_d")).agg(F.max("_d")).first()[0] or 0
        found = _percentiles(freq.where(has), percentiles, most > window_values)
        out = out.join(found, out["_key"].eqNullSafe(found["_k"]), "left").drop("_k")
    return out.withColumnRenamed("_key", key_name)


def _percentiles(freq: DataFrame, percentiles: Sequence[float], ranges: bool) -> DataFrame:
    """``(_k, percentiles)`` from the non-null weighted values."""
    if ranges:
        freq = store_table(freq.repartitionByRange("_key", "_value").withColumn("_range", F.spark_partition_id()))
        whole = Window.partitionBy("_key")
        upto = whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
        sums = freq.groupBy("_key", "_range").agg(F.sum("_n").alias("_m"))
        sums = sums.select(F.col("_key").alias("_rk"), F.col("_range").alias("_rr"), F.coalesce(F.sum("_m").over(upto), F.lit(0)).alias("_before"), F.sum("_m").over(whole).alias("_all"))
        freq = freq.join(sums, F.col("_key").eqNullSafe(F.col("_rk")) & (F.col("_range") == F.col("_rr")))
        running = F.col("_before") + F.sum("_n").over(Window.partitionBy("_key", "_range").orderBy("_value"))
    else:
        freq = freq.withColumn("_all", F.sum("_n").over(Window.partitionBy("_key")))
        running = F.sum("_n").over(Window.partitionBy("_key").orderBy("_value"))
    freq = freq.withColumn("_run", running)
    picks = [F.min(F.when(F.col("_run") >= F.lit(float(p)) * F.col("_all"), F.col("_value"))) for p in percentiles]
    return freq.groupBy(F.col("_key").alias("_k")).agg(F.array(*picks).alias("percentiles"))


def hot_keys(df: DataFrame, fields: dict[str, Column], value: Column, share: float) -> DataFrame:
    """``(field, hot_key, n_rows)``: the keys of each field that hold at least ``share`` of all rows of ``df``.

    Null and blank keys are none, but their rows count in the total. All fields are compressed in one pass. At most
    ``1 / share`` keys per field can come out, so the result is small at every size; an empty table gives no rows.
    """
    if not 0 < share <= 1:
        raise ValueError("share must lie in (0, 1]")
    total = df.count()
    pairs = F.explode(F.array(*[F.struct(F.lit(name).alias("field"), key.alias("key")) for name, key in fields.items()]))
    rows = df.select(pairs.alias("_p"), value.alias("_v"))
    profile = key_profile(rows, F.col("_p"), F.col("_v"))
    key = F.col("key.key")
    return profile.where(key.isNotNull() & (key != "") & (F.col("n_rows") >= F.lit(share) * F.lit(total))).select(F.col("key.field").alias("field"), key.alias("hot_key"), "n_rows")


def key_history(df: DataFrame, key: Column, time: Column, chunk_rows: int = 10_000, *, key_name: str = "key", payload: Sequence[str] = ()) -> DataFrame:
    """The time-ordered history of every key, in chunks: ``(key_name, chunk, events)``.

    ``events`` is an array of structs of ``seq`` (1 for the key's first event), ``time`` and the ``payload`` columns;
    a chunk holds the events of one key whose ``seq - 1`` has the same quotient by ``chunk_rows``. Events without a time
    come first. Ties are ordered by the payload, rows equal in all of it are kept. Null keys are left out. ``time`` is in
    milliseconds. Positions come from the compressed (key, day) counts, so no task orders a whole key.
    """
    distinct_names(key_name, "chunk", "events")
    distinct_names("seq", "time", *payload)
    rows = df.select(key.alias("_key"), time.cast("bigint").alias("_time"), *[F.col(c).alias(c) for c in payload]).where(F.col("_key").isNotNull())
    spread = F.pmod(F.xxhash64(*payload) if payload else F.lit(0), F.lit(64))
    rows = rows.withColumn("_slot", F.when(F.col("_time").isNull(), spread - 2**40).otherwise(F.floor(F.col("_time") / 86_400_000)).cast("bigint"))
    days = rows.groupBy("_key", "_slot").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_key").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    days = days.select(F.col("_key").alias("_dk"), F.col("_slot").alias("_ds"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    placed = rows.join(days, (F.col("_key") == F.col("_dk")) & (F.col("_slot") == F.col("_ds"))).drop("_dk", "_ds")
    within = F.row_number().over(Window.partitionBy("_key", "_slot").orderBy("_time", *payload))
    placed = placed.withColumn("_seq", F.col("_before") + within)
    event = F.struct(F.col("_seq").alias("seq"), F.col("_time").alias("time"), *payload)
    chunk = F.floor((F.col("_seq") - 1) / chunk_rows).cast("bigint")
    return placed.groupBy(F.col("_key").alias(key_name), chunk.alias("chunk")).agg(F.array_sort(F.collect_list(event)).alias("events"))
